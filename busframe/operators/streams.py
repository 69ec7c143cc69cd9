"""Operators over ordered message streams: gaps, merging, duplicates, filters and the order of ties.

A stream is a DataFrame with file_idx, seq (place in the file), us, rt, sa, dir. Order is always in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("rt", "sa", "dir")
#: Places of a stream that one task of a window holds at most.
BLOCK = 1 << 20


def _gap(us: Column, before: Column) -> Column:
    return F.when(before.isNull(), us - us).when(us >= before, us - before)


def _with_blocks(df: DataFrame, per_block: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of per_block for its keys and block; nulls are keys like others."""
    own = per_block.withColumnsRenamed({k: f"own_{k}" for k in [*keys, "block"]})
    same = F.col("block") == F.col("own_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"own_{k}"))
    return df.join(own, same).drop(*[f"own_{k}" for k in [*keys, "block"]])


def carried_lag(df: DataFrame, keys: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """before: the value of the row before in its keys. Values are not null; order is a long. A key is cut into
    blocks of order, so none is too large for a task; the last value of each block is carried by a small table."""
    df = df.withColumn("block", F.floor(F.col(order) / block).cast("long"))
    ends = df.groupBy(*keys, "block").agg(F.max_by(value, order).alias("end"))
    over = Window.partitionBy(*keys).orderBy("block") if keys else Window.orderBy("block")
    ends = ends.withColumn("carried", F.lag("end").over(over)).drop("end")
    inside = F.lag(value).over(Window.partitionBy(*keys, "block").orderBy(order))
    return _with_blocks(df.withColumn("inside", inside), ends, keys).withColumn("before", F.coalesce("inside", "carried")).drop("block", "inside", "carried")


def carried_max(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """out: the greatest value up to a row in its keys, by blocks as in carried_lag."""
    df = df.withColumn("block", F.floor(F.col(order) / block).cast("long"))
    tops = df.groupBy(*keys, "block").agg(F.max(value).alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("carried", F.max("top").over(earlier)).drop("top")
    upto = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_blocks(df.withColumn("inside", F.max(value).over(upto)), tops, keys).withColumn(out, F.greatest("inside", "carried")).drop("block", "inside", "carried")


def delta_per_file(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """delta_us since the last message of the same key in the file: 0 for the first, null after a backward step."""
    return carried_lag(df, ["file_idx", *KEY], "seq", "us", block).withColumn("delta_us", _gap(F.col("us"), F.col("before"))).drop("before")


def timed_gaps(df: DataFrame, gaps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the delta_us that gaps gives messages with a clock and a key; the others have none and count in no gap."""
    timed = F.col("us").isNotNull() & F.col("rt").isNotNull()
    some = gaps(df.filter(timed))
    return some.unionByName(df.filter(~timed).withColumn("delta_us", F.lit(None).cast(some.schema["delta_us"].dataType)))


def backward_steps(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of each file and key, the first message earlier than the one before it, and how many there are."""
    timed = df.filter("us is not null and rt is not null")
    back = carried_lag(timed, ["file_idx", *KEY], "seq", "us", block).filter("us < before")
    return back.groupBy("file_idx", *KEY).agg(F.min("seq").alias("first_seq"), F.count("*").alias("steps"))


def merge_key(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """run_max: ordering by run_max, file_idx, seq is the order of a merge of files that may step backward."""
    return carried_max(df, ["file_idx"], "seq", "us", "run_max", block)


def delta_global(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """delta_us since the last message of the same key in the merged stream; with its position pos."""
    df = df if "pos" in df.columns else positions(df)
    return carried_lag(df, list(KEY), "pos", "us", block).withColumn("delta_us", _gap(F.col("us"), F.col("before"))).drop("before")


def collapse_exact(df: DataFrame, content: list[str]) -> DataFrame:
    """Of equal messages at one time those of the first file stay."""
    return df.withColumn("first_file", F.min("file_idx").over(Window.partitionBy("us", *content))).filter("file_idx = first_file").drop("first_file")


def spurious_code(df: DataFrame) -> DataFrame:
    """code of spurious records: 2000 right behind an errored record of the same file and epoch, else 2001."""
    df = df.withColumn("erred", (F.col("is_err") & ~F.col("spurious")).cast("int"))
    behind = F.coalesce(F.col("before") == 1, F.lit(False))
    return carried_lag(df, ["file_idx", "epoch"], "seq", "erred").withColumn("code", F.when(F.col("spurious"), F.when(behind, "2000").otherwise("2001"))).drop("erred", "before")


def _member(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def keep_messages(df: DataFrame, exclude: dict[str, list] | None = None, include: dict[str, list] | None = None) -> DataFrame:
    """Without what any exclude list names, and with only what all include lists name; nulls are in no list."""
    for column, values in (exclude or {}).items():
        df = df.filter(~_member(column, values))
    for column, values in (include or {}).items():
        df = df.filter(_member(column, values))
    return df


def canonical_order(df: DataFrame, cap: int = 4096) -> DataFrame:
    """Within a timestamp of a time-ordered stream (pos): by rt, sa, dir; a message without a key stays behind the one
    it followed. A run of one timestamp is cut into buffers of cap, and a full one keeps its order. Adds place."""
    run = Window.partitionBy("us").orderBy("pos")
    df = df.withColumn("chunk", F.floor((F.row_number().over(run) - 1) / cap))
    chunk = Window.partitionBy("us", "chunk")
    upto = chunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("full", F.count("*").over(chunk) == cap)
    anchor = F.last(F.when(F.col("rt").isNotNull(), F.struct(*KEY, "pos")), ignorenulls=True).over(upto)
    df = df.withColumn("anchor", anchor)
    low = lambda c: F.when(F.col("full"), -1).otherwise(F.coalesce(F.col(f"anchor.{c}"), F.lit(-1)))
    order = chunk.orderBy(*[low(c) for c in KEY], F.when(F.col("full"), -1).otherwise(F.coalesce(F.col("anchor.pos"), F.lit(-1))), "pos")
    return df.withColumn("place", F.row_number().over(order)).drop("anchor", "full")


def positions(df: DataFrame, span: int = 60_000_000) -> DataFrame:
    """pos: the place in merge order, from 0. Rows are numbered in spans of time, and spans by a table of their counts."""
    df = merge_key(df).withColumn("span", F.floor(F.col("run_max") / span).cast("long"))
    inside = F.row_number().over(Window.partitionBy("span").orderBy("run_max", "file_idx", "seq"))
    counts = df.groupBy("span").agg(F.count("*").alias("k"))
    ahead = counts.select("span", F.coalesce(F.sum("k").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return df.withColumn("inside", inside).join(ahead, "span").withColumn("pos", F.col("ahead") + F.col("inside") - 1).drop("span", "inside", "ahead")


def runs(df: DataFrame, group: str = "us", block: int = BLOCK) -> DataFrame:
    """run: the number of the run of consecutive equal values of group that a row of a stream (pos) is in."""
    df = carried_lag(df, [], "pos", group, block)
    df = df.withColumn("step", F.coalesce((F.col("before") != F.col(group)).cast("long"), F.lit(0))).withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    sums = df.groupBy("block").agg(F.sum("step").alias("s"))
    sums = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.sum("step").over(Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("upto", upto).join(sums, "block").withColumn("run", F.col("base") + F.col("upto")).drop("block", "base", "upto", "step", "before")


def canonical_order_any(df: DataFrame, cap: int = 4096, block: int = BLOCK) -> DataFrame:
    """canonical_order of a stream (pos, us not null) that may step backward: runs take the part of timestamps.

    Ordering by run, chunk, place is the order of the output."""
    df = runs(df, "us", block).withColumnsRenamed({"us": "own_us", "run": "us"})
    return canonical_order(df, cap).withColumnsRenamed({"us": "run", "own_us": "us"})


def collapse_window(df: DataFrame, content: list[str], window_us: int) -> DataFrame:
    """Without messages that repeat, at most window_us apart, the content of a kept message of another file.

    Rows go through in merge order, past a queue of the kept ones of the last window_us: sorted by content where no
    file steps backward, else (where what is forgotten depends on all rows between) as one stream in one task. Either
    way a task holds one window."""
    df = merge_key(df).withColumn("wire", F.to_json(F.struct(*content)))
    steady = df.filter("us < run_max").isEmpty()
    order = ["run_max", "file_idx", "seq"]
    df = df.repartition("wire").sortWithinPartitions("wire", *order) if steady else df.repartition(1).sortWithinPartitions(*order)

    def kept(batches):
        from collections import defaultdict, deque

        import pyarrow as pa

        queue, of, at = deque(), defaultdict(deque), None
        for batch in batches:
            mask = []
            for us, file, wire in zip(*(batch.column(c).to_pylist() for c in ("us", "file_idx", "wire")), strict=True):
                if steady and wire != at:
                    queue.clear(), of.clear()
                    at = wire
                while queue and us - queue[0][0] > window_us:
                    gone = queue.popleft()[1]
                    of[gone].popleft()
                    if not of[gone]:
                        del of[gone]
                mask.append(not any(f != file and abs(u - us) <= window_us for u, f in of.get(wire, ())))
                if mask[-1]:
                    queue.append((us, wire))
                    of[wire].append((us, file))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(kept, df.schema).drop("wire")


def file_backward(df: DataFrame) -> DataFrame:
    """Of each file that steps backward the first message that does, and the time before it."""
    back = carried_lag(df.filter("us is not null"), ["file_idx"], "seq", "us").filter("us < before")
    return back.groupBy("file_idx").agg(F.min(F.struct("seq", "before", "us")).alias("x")).select("file_idx", "x.seq", "x.before", "x.us")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """A row with how many messages there are, how many keys, and how many messages repeat one."""
    n = df.groupBy(*keys).count()
    return n.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("messages"), F.count("*").alias("keys")).withColumn("repeats", F.col("messages") - F.col("keys"))


RULES = {
    "rt_msg": ("rt", "sa", "dir"), "rt_sa": ("rt", "sa"), "rt": ("rt",), "rt_msg_bus": ("rt", "sa", "dir", "bus"), "msg": ("sa", "dir"), "bus": ("bus",), "any": (),
}
UNITS = {"seconds": 1e6, "milliseconds": 1e3, "microseconds": 1.0}


def delta_rules(df: DataFrame, decimals: int = 6, block: int = BLOCK) -> DataFrame:
    """How well each rule for a gap explains the column actual of a stream (pos, us, rt, sa, dir, bus): rule, unit, first
    (what a key's first message shows), matched and comparable. A message without clock or key should show nothing."""
    # Joining by || and not concat_ws: a missing part makes the key missing.
    key = lambda cols: F.concat(F.lit("k"), *[F.concat(F.lit(":"), F.col(c).cast("string")) for c in cols])
    wide = df.select("pos", "us", F.trim(F.coalesce("actual", F.lit(""))).alias("actual"), F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), key(cols).alias("key")) for name, cols in RULES.items()])).alias("r"))
    wide = wide.select("pos", "us", "actual", "r.rule", "r.key")
    takes = F.col("us").isNotNull() & F.col("key").isNotNull()
    part = carried_lag(wide.filter(takes), ["rule", "key"], "pos", "us", block).select("rule", "actual", "us", "before", F.lit(True).alias("takes"))
    none = wide.filter(~takes).select("rule", "actual", "us", F.lit(None).cast("long").alias("before"), F.lit(False).alias("takes"))

    def hit(divisor: float, first: str) -> Column:
        gap = F.format_string(f"%.{decimals}f", (F.col("us") - F.col("before")).cast("double") / divisor)
        start = F.format_string(f"%.{decimals}f", F.lit(0.0)) if first == "zero" else F.lit("")
        want = F.when(~F.col("takes"), "").when(F.col("before").isNull(), start).when(F.col("us") >= F.col("before"), gap).otherwise("")
        return F.count_if(want == F.col("actual"))

    kinds = [(u, f) for u in UNITS for f in ("zero", "empty")]
    sums = part.unionByName(none).groupBy("rule").agg(F.count("*").alias("comparable"), *[hit(UNITS[u], f).alias(f"{u}_{f}") for u, f in kinds])
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(f).alias("first"), F.col(f"{u}_{f}").alias("matched")) for u, f in kinds]))
    return sums.select("rule", "comparable", each.alias("x")).select("rule", "x.unit", "x.first", "x.matched", "comparable")
