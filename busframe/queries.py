"""The registered queries: operators over words made of the tables by integer arithmetic, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busframe.functions import dump as D
from busframe.functions import words as W
from busframe.operators import classify as C
from busframe.operators import messages as M
from busframe.operators import streams as S


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", (F.col("event_id") % 3).cast("int").alias("file_idx"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000).alias("us"), (F.col("user_id") % 32).cast("int").alias("rt"), (F.col("event_id") % 32).cast("int").alias("sa"), (F.floor(F.col("event_id") / 32) % 2).cast("int").alias("dir"), (F.col("event_type") == "error").alias("is_err"))


EVENTS = "(select event_id, cast(event_id % 3 as int) file_idx, event_id seq, epoch_us(ts) - 1704067200000000 us, cast(user_id % 32 as int) rt, cast(event_id % 32 as int) sa, cast((event_id // 32) % 2 as int) dir, event_type = 'error' is_err from events)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    u = lambda a, b: ((F.col("l_orderkey") * a + F.col("l_linenumber") * b) % 65536).cast("int")
    return x.select("l_orderkey", "l_linenumber", u(31, 1).alias("u"), u(77, 13).alias("v"), u(191, 7).alias("x"))


LINES = "(select l_orderkey, l_linenumber, cast((l_orderkey * 31 + l_linenumber) % 65536 as int) u, cast((l_orderkey * 77 + l_linenumber * 13) % 65536 as int) v, cast((l_orderkey * 191 + l_linenumber * 7) % 65536 as int) x from lineitem)"
IRIG = "select *, (u >> 5) & 511 as day_, u & 31 as hour_, (v >> 10) & 63 minute_, (v >> 4) & 63 second_, ((v & 15) << 16) | x micros_, ((u >> 15) & 1) = 1 freerun_ from " + LINES
FORMAT = "case t when 2 then 'RECEIVE' when 4 then 'TRANSMIT' when 8 then 'RT_TO_RT' when 16 then 'RECEIVE_BROADCAST' when 24 then 'RT_TO_RT_BROADCAST' when 32 then 'SPURIOUS_DATA' else case when rt = 31 and wc >= 6 then 'MODE_CODE_BCAST_DATA' when rt = 31 then 'MODE_CODE_BCAST_NO_DATA' when wc < 7 then 'MODE_CODE_NO_DATA' when dir = 1 then 'MODE_CODE_TX_DATA' else 'MODE_CODE_RX_DATA' end end"
RECORDS = f"(select *, {FORMAT} fmt from (select l_orderkey, l_linenumber, u, v, [1, 2, 4, 8, 16, 24, 32][l_linenumber] t, (v >> 8) & 63 wc, u >> 11 rt, (u >> 10) & 1 dir, case when u & 31 = 0 then 32 else u & 31 end n from {LINES}))"


def records(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d)
    c = W.command_word(F.col("u"))
    kinds = F.array(*[F.lit(t) for t in W.MESSAGE_TYPES])
    df = df.select("l_orderkey", "l_linenumber", "u", "v", F.get(kinds, F.col("l_linenumber").cast("int") - 1).alias("t"), W.bits(F.col("v"), 8, 6).alias("wc"), c["rt"].alias("rt"), c["dir"].alias("dir"), c["n"].alias("n"))
    return df.withColumn("fmt", C.message_format(F.col("t"), F.col("rt"), F.col("dir"), F.col("wc"), F.lit(3)))


@query(f"select l_orderkey, l_linenumber, u & 127 msg_type, (u >> 7) & 1 bus, (u >> 8) & 63 word_count, (u >> 14) & 1 = 1 is_err, (u >> 15) & 1 = 1 reserved from {LINES}")
def type_word_decode(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in W.type_word(F.col("u")).items()])


@query(f"select l_orderkey, l_linenumber, u >> 11 rt, (u >> 10) & 1 dir, (u >> 5) & 31 sa, case when u & 31 = 0 then 32 else u & 31 end n, u >> 11 = 31 broadcast, (u >> 5) & 31 in (0, 31) mode_code from {LINES}")
def command_word_decode(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in W.command_word(F.col("u")).items()])


@query(f"select l_orderkey, l_linenumber, (cast(day_ * 86400 + hour_ * 3600 + minute_ * 60 + second_ as bigint)) * 1000000 + micros_ us, freerun_ freerun, printf('%d:%02d:%02d:%02d.%06d', day_, hour_, minute_, second_, micros_ % 1000000) time_stamp from ({IRIG})")
def irig_decode(spark, d):
    t = W.irig(F.col("u"), F.col("v"), F.col("x"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", W.irig_us(t).alias("us"), t["freerun"].alias("freerun"), W.irig_text(t).alias("time_stamp"))


@query(f"select l_orderkey, l_linenumber, printf('0x%08X', cast(u as bigint) * 65536 + v) time_stamp from {LINES}")
def standard_text(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", W.standard_text(F.shiftleft(F.col("u").cast("long"), 16).bitwiseOR(F.col("v").cast("long"))).alias("time_stamp"))


@query(f"select l_orderkey, l_linenumber, fmt from {RECORDS}")
def format_classify(spark, d):
    return records(spark, d).select("l_orderkey", "l_linenumber", "fmt")


@query(f"""select l_orderkey, l_linenumber, case when fmt = 'RECEIVE' and dir = 1 then 'DIRECTION_NOT_RECEIVE' when fmt = 'TRANSMIT' and dir = 0 then 'DIRECTION_NOT_TRANSMIT'
when fmt <> 'SPURIOUS_DATA' and wc < 5 + case fmt when 'RECEIVE' then n + 1 when 'TRANSMIT' then n + 1 when 'RT_TO_RT' then n + 3 when 'RECEIVE_BROADCAST' then n when 'RT_TO_RT_BROADCAST' then n + 2
when 'MODE_CODE_TX_DATA' then 2 when 'MODE_CODE_RX_DATA' then 2 when 'MODE_CODE_NO_DATA' then 1 when 'MODE_CODE_BCAST_DATA' then 1 else 0 end then 'CAPACITY' end reason from {RECORDS}""")
def invariant_reject(spark, d):
    return records(spark, d).select("l_orderkey", "l_linenumber", C.reject_reason(F.col("fmt"), F.col("dir"), F.col("n"), F.col("wc"), F.lit(3)).alias("reason"))


@query(f"""select l_orderkey, l_linenumber, case when l_orderkey % 50 * 2 + 2 > 98 - v % 4 then 'UNREADABLE' when u & 127 not in (1, 2, 4, 8, 16, 24, 32) then 'UNKNOWN_TYPE' when (u >> 8) & 63 < 5 then 'WORD_COUNT'
when l_orderkey % 50 * 2 + 2 * ((u >> 8) & 63) > 98 - v % 4 then 'TRUNCATED' when hour_ >= 24 then 'HOUR' when minute_ >= 60 then 'MINUTE'
when second_ >= 60 then 'SECOND' when micros_ > 999999 then 'MICROS' when not freerun_ and (day_ < 1 or day_ > 366) then 'DAY' end reason from ({IRIG})""")
def validate_reason(spark, d):
    t, tw = W.irig(F.col("u"), F.col("v"), F.col("x")), W.type_word(F.col("u"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", C.invalid_reason(t, tw["msg_type"], tw["word_count"], F.col("l_orderkey") % 50 * 2, 98 - F.col("v") % 4, 5).alias("reason"))


@query(f"""select l_orderkey, irig, standard, case when greatest(irig, standard) < 4 or abs(irig - standard) < 3 then 'AMBIGUOUS' when greatest(irig, standard) >= 8 and abs(irig - standard) >= 6 then 'DECISIVE' else 'MARGINAL' end confidence
from (select l_orderkey, cast(sum(u % 6) as bigint) irig, cast(sum(v % 5) as bigint) standard from {LINES} group by 1)""")
def probe_confidence(spark, d):
    g = lines(spark, d).groupBy("l_orderkey").agg(F.sum(F.col("u") % 6).alias("irig"), F.sum(F.col("v") % 5).alias("standard"))
    return g.withColumn("confidence", C.confidence(F.col("irig"), F.col("standard")))


KEYS = "rt, sa, dir"


@query(f"select event_id, case when b is null then 0 when us >= b then us - b end delta_us from (select *, lag(us) over (partition by file_idx, {KEYS} order by seq) b from {EVENTS})")
def delta_per_file(spark, d):
    return S.delta_per_file(events(spark, d)).select("event_id", "delta_us")


MERGED = f"(select *, max(us) over (partition by file_idx order by seq rows unbounded preceding) run_max from {EVENTS})"


@query(f"select event_id, case when b is null then 0 when us >= b then us - b end delta_us from (select *, lag(us) over (partition by {KEYS} order by run_max, file_idx, seq) b from {MERGED})")
def delta_global(spark, d):
    return S.delta_global(events(spark, d)).select("event_id", "delta_us")


@query(f"select event_id, run_max from {MERGED}")
def merge_order(spark, d):
    return S.merge_key(events(spark, d)).select("event_id", "run_max")


@query(f"select event_id from (select *, min(file_idx) over (partition by us // 60000000, {KEYS}) f from {EVENTS}) where f = file_idx")
def collapse_exact(spark, d):
    e = events(spark, d).withColumn("us", F.floor(F.col("us") / 60000000))
    return S.collapse_exact(e, list(S.KEY)).select("event_id")


@query(f"select event_id, case when sa % 4 = 0 then case when coalesce(lag(is_err and sa % 4 <> 0) over (partition by file_idx order by seq), false) then '2000' else '2001' end end code from {EVENTS}")
def spurious_code(spark, d):
    e = events(spark, d).withColumns({"spurious": F.col("sa") % 4 == 0, "epoch": F.lit(0)})
    return S.spurious_code(e).select("event_id", "code")


@query(f"select event_id from {EVENTS} where not (rt in (1, 2, 31) or sa in (0, 31))")
def filter_exclude(spark, d):
    return S.keep_messages(events(spark, d), exclude={"rt": [1, 2, 31], "sa": [0, 31]}).select("event_id")


@query(f"select event_id from {EVENTS} where rt in (3, 4, 5, 6) and dir = 1 and not sa in (7)")
def filter_include(spark, d):
    return S.keep_messages(events(spark, d), {"sa": [7]}, {"rt": [3, 4, 5, 6], "dir": [1]}).select("event_id")


def _canonical(cap: int) -> str:
    key = lambda c: f"case when f then -1 else coalesce(a.{c}, -1) end"
    return f"""with e as (select event_id pos, us // 3600000000 us, case when is_err then null else rt end rt, sa, dir from {EVENTS}),
c as (select *, (row_number() over (partition by us order by pos) - 1) // {cap} chunk from e),
g as (select *, count(*) over (partition by us, chunk) = {cap} f, last_value(case when rt is not null then struct_pack(rt := rt, sa := sa, dir := dir, pos := pos) end ignore nulls) over (partition by us, chunk order by pos rows unbounded preceding) a from c)
select pos, cast(chunk as bigint) chunk, cast(row_number() over (partition by us, chunk order by {key('rt')}, {key('sa')}, {key('dir')}, {key('pos')}, pos) as int) place from g"""


def _tied(spark, d):
    return events(spark, d).select(F.col("event_id").alias("pos"), F.floor(F.col("us") / 3600000000).alias("us"), F.when(~F.col("is_err"), F.col("rt")).alias("rt"), "sa", "dir")


@query(_canonical(4096))
def canonical_order(spark, d):
    return S.canonical_order(_tied(spark, d)).select("pos", "chunk", "place")


@query(_canonical(5))
def canonical_order_capped(spark, d):
    return S.canonical_order(_tied(spark, d), 5).select("pos", "chunk", "place")


@query("select page_id, nullif(trim(split_part(url, '/', 4)), '') mux from pages")
def mux_field(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", W.mux(F.col("url"), "/", 3).alias("mux"))


@query(f"select count(*) n_messages, count(*) filter (where is_err) n_errors from {EVENTS}")
def record_count(spark, d):
    return events(spark, d).agg(F.count("*").alias("n_messages"), F.count_if("is_err").alias("n_errors"))


@query(f"select event_id, row_number() over (order by run_max, file_idx, seq) - 1 pos from {MERGED}")
def merge_position(spark, d):
    return S.positions(events(spark, d), 3_600_000_000).select("event_id", "pos")


STEPPING = f"(select event_id, file_idx, seq, rt, sa, dir, us + (event_id % 7) * 7200000000 us from {EVENTS})"


def _stepping(spark, d, step=7200000000):
    return events(spark, d).withColumn("us", F.col("us") + (F.col("event_id") % 7) * step)


#: Between two messages of a key lie some days, so a key only steps backward by much.
FAR = 2592000000000


@query(f"select file_idx, sa, dir, min(seq) first_seq, count(*) steps from (select *, lag(us) over (partition by file_idx, sa, dir order by seq) b from (select * replace (us + (event_id % 7) * {FAR} as us) from {EVENTS})) where us < b group by all")
def delta_backward(spark, d):
    """With one terminal, so that keys come often enough to step backward."""
    return S.backward_steps(_stepping(spark, d, FAR).withColumn("rt", F.lit(1))).drop("rt")


TIMED = f"(select event_id, file_idx, seq, case when event_id % 11 > 0 then us end us, case when not is_err then rt % 4 end rt, sa % 4 sa, dir from {EVENTS})"


def _timed(spark, d):
    e = events(spark, d)
    return e.withColumns({"us": F.when(F.col("event_id") % 11 > 0, F.col("us")), "rt": F.when(~F.col("is_err"), F.col("rt") % 4), "sa": F.col("sa") % 4})


@query(f"select e.event_id, g.delta_us from {TIMED} e left join (select event_id, case when b is null then 0 when us >= b then us - b end delta_us from (select *, lag(us) over (partition by file_idx, {KEYS} order by seq) b from {TIMED} where us is not null and rt is not null)) g using (event_id)")
def delta_of_timed(spark, d):
    """Messages without a clock or a key have no gap and count in none."""
    return S.timed_gaps(_timed(spark, d), lambda x: S.delta_per_file(x, 4096)).select("event_id", "delta_us")


@query(f"select count(*) messages, count(distinct (rt, sa, dir)) keys, count(*) - count(distinct (rt, sa, dir)) repeats from {TIMED} where rt is not null")
def repeated_keys(spark, d):
    return S.repeated_keys(_timed(spark, d).filter("rt is not null"), *S.KEY)


@query(f"select cast(count(*) filter (where rt in (3, 4, 5, 6) and dir = 1 and not sa in (7)) as bigint) passed, cast(count(*) filter (where not (rt in (3, 4, 5, 6) and dir = 1 and not sa in (7))) as bigint) excluded from {EVENTS}")
def filter_tally(spark, d):
    e = events(spark, d)
    n, kept = e.agg(F.count("*").alias("n")), S.keep_messages(e, {"sa": [7]}, {"rt": [3, 4, 5, 6], "dir": [1]}).agg(F.count("*").alias("passed"))
    return n.join(F.broadcast(kept)).select("passed", (F.col("n") - F.col("passed")).alias("excluded"))  # a row each


@query(f"select file_idx, min(seq) seq, min_by(b, seq) before, min_by(us, seq) us from (select *, lag(us) over (partition by file_idx order by seq) b from {STEPPING}) where us < b group by 1")
def monotonic_check(spark, d):
    return S.file_backward(_stepping(spark, d))


def _back(spark, d):
    """The events as one stream in which time steps backward."""
    e = events(spark, d)
    return e.select(F.col("event_id").alias("pos"), F.floor((F.col("us") + (F.col("event_id") % 7) * 7200000000) / 3600000000).alias("us"), F.when(~F.col("is_err"), F.col("rt")).alias("rt"), "sa", "dir", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("bus"))


BACK = f"(select event_id pos, (us + (event_id % 7) * 7200000000) // 3600000000 us, case when is_err then null else rt end rt, sa, dir, case when event_id % 2 = 0 then 'A' else 'B' end bus from {EVENTS})"


@query(f"select pos, cast(sum(step) over (order by pos rows unbounded preceding) as bigint) run from (select *, case when us <> lag(us) over (order by pos) then 1 else 0 end step from {BACK})")
def tie_runs(spark, d):
    return S.runs(_back(spark, d), "us", 4096).select("pos", "run")


RANKED = " union all ".join(
    f"select '{name}' rule, actual, us, {'coalesce(' + ' || '.join(f'cast({c} as varchar)' for c in cols) + ') is not null' if cols else 'true'} takes, lag(us) over (partition by {', '.join(cols) if cols else '1'} order by pos) b from g" for name, cols in S.RULES.items()
)
KINDS = [(u, x, f) for u, x in S.UNITS.items() for f in ("zero", "empty")]


@query(f"""with g as (select *, case when rt is null then '' when b0 is null then '0.000000' when us >= b0 then printf('%.6f', cast(us - b0 as double) / 1e6) else '' end actual from (select *, lag(us) over (partition by rt, sa, dir order by pos) b0 from {BACK})),
r as ({RANKED}) """ + " union all ".join(f"select rule, '{u}' unit, '{f}' as \"first\", count(*) filter (where actual = case when not takes then '' when b is null then '{'0.000000' if f == 'zero' else ''}' when us >= b then printf('%.6f', cast(us - b as double) / {x!r}) else '' end) matched, count(*) comparable from r group by 1" for u, x, f in KINDS))
def delta_rule_rank(spark, d):
    g = _back(spark, d)
    w = Window.partitionBy("rt", "sa", "dir").orderBy("pos")
    gap = F.col("us") - F.lag("us").over(w)
    actual = F.when(F.col("rt").isNull(), "").when(gap.isNull(), "0.000000").when(gap >= 0, F.format_string("%.6f", gap.cast("double") / 1e6)).otherwise("")
    return S.delta_rules(g.withColumn("actual", actual), 6, 4096)


DAY = 86_400_000_000
COLLAPSED = f"""with recursive e as (select *, row_number() over (partition by s, dir order by run_max, file_idx, seq) n from (select *, sa % 8 s from {MERGED})),
f as (select s, dir, cast(0 as bigint) n, cast([] as struct(us bigint, f int)[]) kept, cast(-1 as bigint) event_id, false keep from e group by s, dir
union all select s, dir, n, case when twin then kept else list_append(list_filter(kept, lambda k: us - k.us <= {DAY}), {{'us': us, 'f': file_idx}}) end, event_id, not twin
from (select e.*, f.kept, len(list_filter(f.kept, lambda k: k.f <> e.file_idx and abs(k.us - e.us) <= {DAY})) > 0 twin from f join e on e.s = f.s and e.dir = f.dir and e.n = f.n + 1))
select event_id from f where keep"""


@query(COLLAPSED)
def collapse_window(spark, d):
    """Greedy: a message goes if one before it that stays has its content; tests also hold streams that step backward against a plain loop."""
    return S.collapse_window(events(spark, d).withColumn("s", F.col("sa") % 8), ["s", "dir"], DAY).select("event_id")


@query(f"select l_orderkey, l_linenumber, v >> 11 rt, (v >> 10) & 1 = 1 message_error, (v >> 8) & 1 = 1 service_request, (v >> 3) & 1 = 1 busy, v & 1 = 1 terminal, case when v >> 11 <> u >> 11 then 'STATUS_RT' else '' end || case when v >> 11 <> u >> 11 and x >> 15 = 1 then ',' else '' end || case when x >> 15 = 1 then 'RESERVED_BIT' else '' end anomalies from {LINES}")
def anomaly_flags(spark, d):
    st, c, tw = C.status_word(F.col("v")), W.command_word(F.col("u")), W.type_word(F.col("x"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", *[st[k].alias(k) for k in ("rt", "message_error", "service_request", "busy", "terminal")], F.array_join(C.anomalies(F.col("v"), c["rt"], tw["reserved"]), ",").alias("anomalies"))


@query(f"select l_orderkey, l_linenumber, cast(case when y - floor(y) >= 0.5 then floor(y) + 1 else floor(y) end as bigint) us from (select l_orderkey, l_linenumber, case when hz > 0 then (cast(u as bigint) * 65536 + v) * 1e6::double / hz end y from (select *, (x % 9) * 125000.0::double hz from {LINES}))")
def tick_calibration(spark, d):
    ticks, hz = F.shiftleft(F.col("u").cast("long"), 16).bitwiseOR(F.col("v").cast("long")), (F.col("x") % 9) * F.lit(125000.0)
    return lines(spark, d).select("l_orderkey", "l_linenumber", W.ticks_to_us(ticks, hz).cast("long").alias("us"))


PLACED = f"(select *, 5 + l_orderkey % 40 m from {RECORDS})"
WORD = "((l_orderkey * 7 + l_linenumber * 3 + ({}) * 11) % 65536)"
START = "case when fmt in ('RECEIVE', 'RECEIVE_BROADCAST', 'MODE_CODE_RX_DATA', 'MODE_CODE_BCAST_DATA') then 5 when fmt in ('TRANSMIT', 'MODE_CODE_TX_DATA') then 6 when fmt in ('RT_TO_RT', 'RT_TO_RT_BROADCAST') then 7 end"
MANY = "case when fmt in ('MODE_CODE_RX_DATA', 'MODE_CODE_BCAST_DATA', 'MODE_CODE_TX_DATA') then 1 else n end"
STATUS_AT = "case when fmt in ('TRANSMIT', 'MODE_CODE_TX_DATA', 'MODE_CODE_NO_DATA') then 5 when fmt = 'RECEIVE' then 5 + n when fmt in ('MODE_CODE_RX_DATA', 'RT_TO_RT', 'RT_TO_RT_BROADCAST') then 6 end"


@query(f"""select l_orderkey, l_linenumber, cast(case when at_ < m then {WORD.format('at_')} end as int) status, case when start_ + many <= m then array_to_string(list_transform(range(start_, start_ + many), lambda i: {WORD.format('i')}), ',') else '' end data
from (select *, {STATUS_AT} at_, {START} start_, {MANY} many from {PLACED})""")
def payload_words(spark, d):
    df = records(spark, d)
    word = lambda i: ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + i * 11) % 65536).cast("int")
    df = df.withColumn("w", F.transform(F.sequence(F.lit(0), 4 + (F.col("l_orderkey") % 40).cast("int")), word))
    own = C.payload(F.col("fmt"), F.col("w"), F.lit(5), F.col("n"))
    return df.select("l_orderkey", "l_linenumber", own["status"].alias("status"), F.array_join(own["data_words"], ",").alias("data"))


@query(f"select l_orderkey, l_linenumber, case when t in (8, 24) then case when (v >> 10) & 1 = 1 then 'CMD2_DIRECTION' when n <> case when v & 31 = 0 then 32 else v & 31 end then 'CMD2_COUNT' end end reason from {RECORDS}")
def late_reject(spark, d):
    c2 = W.command_word(F.col("v"))
    return records(spark, d).select("l_orderkey", "l_linenumber", C.late_reject_reason(F.col("fmt"), c2["dir"], F.col("n"), c2["n"]).alias("reason"))


CODE = "[286, 288, 310, 320, 336, 8192, 8193, 0, 287][1 + x % 9]"


@query(f"select l_orderkey, l_linenumber, {CODE} in (286, 288, 310, 320, 336, 8192, 8193) known, coalesce(map {{{', '.join(f"{k}: '{v}'" for k, v in W.ERROR_TITLES.items())}}}[{CODE}], 'unknown') title from {LINES}")
def error_titles(spark, d):
    code = F.get(F.array(*[F.lit(k) for k in (286, 288, 310, 320, 336, 8192, 8193, 0, 287)]), F.col("x") % 9)
    return lines(spark, d).select("l_orderkey", "l_linenumber", W.known_code(code).alias("known"), W.titled(code, W.ERROR_TITLES, F.lit("unknown")).alias("title"))


@query(f"select l_orderkey, l_linenumber, case when x % 7 > 0 then (cast(day_ * 86400 + hour_ * 3600 + minute_ * 60 + second_ as bigint)) * 1000000 + micros_ % 1000000 end us from ({IRIG})")
def vendor_clock(spark, d):
    t = W.irig(F.col("u"), F.col("v"), F.col("x"))
    text = F.when(F.col("x") % 7 > 0, W.irig_text(t)).otherwise(W.standard_text(F.col("u").cast("long")))
    return lines(spark, d).select("l_orderkey", "l_linenumber", W.vendor_us(text).alias("us"))


PARTS = "(select doc_id, octet_length(encode(text)) n, hex(encode(text)) h from documents)"


@query(f"""select doc_id, \"at\", '  ' || printf('%08X', \"at\") || '  ' || rpad(rtrim(regexp_replace(p, '(..)', '\\1 ', 'g')), 48, ' ') || '  |' || array_to_string(list_transform(range(0, length(p) // 2), lambda i: case when substr(p, 2 * i + 1, 2) between '20' and '7E' then chr(cast('0x' || substr(p, 2 * i + 1, 2) as int)) else '.' end), '') || '|' line
from (select doc_id, \"at\", substr(h, 2 * \"at\" + 1, 32) p from (select doc_id, h, unnest(range(0, n, 16)) \"at\" from {PARTS}))""")
def hexdump_lines(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("data"))
    x = x.select("doc_id", F.explode(D.chunks(F.col("data"), *D.window(F.col("data")))).alias("c"))
    return x.select("doc_id", F.col("c.at").alias("at"), D.hex_line(F.col("c.at"), F.col("c.part")).alias("line"))


WORDS = ["u", "v", "x"]


@query(f"""select l_orderkey, l_linenumber, printf('%d:%02d:%02d:%02d.%06d', day_, hour_, minute_, second_, micros_ % 1000000) || ',' || (u >> 11) || ',' || ((u >> 5) & 31) || case when (u >> 10) & 1 = 1 then 'T' else 'R' end || ','
|| printf('%04X,%04X,%04X', u, v, x) || repeat(',', 30) || printf('%04X,%04X', x, u) || ',' || case when x % 5 = 0 then '\"a,' || x || '\"' else '' end || ',,' || case when (v >> 7) & 1 = 0 then 'A' else 'B' end || ',' || printf('%d.%06d', x // 1000, (x % 1000) * 1000) || ',,,,'
|| case when (v >> 14) & 1 = 1 then 'ERROR' else '' end || ',' || case when (v >> 14) & 1 = 1 then printf('%04X', v) else '' end line from ({IRIG})""")
def csv_row_46(spark, d):
    df, t, c = lines(spark, d), W.irig(F.col("u"), F.col("v"), F.col("x")), W.command_word(F.col("u"))
    err = W.bits(F.col("v"), 14, 1) == 1
    df = df.select("l_orderkey", "l_linenumber", W.irig_text(t).alias("time_stamp"), c["rt"].alias("rt"), c["sa"].alias("sa"), c["dir"].alias("dir"), F.array(*WORDS).alias("data_words"), F.col("x").alias("status"), F.col("u").alias("cmd"), F.when(F.col("x") % 5 == 0, F.concat(F.lit("a,"), F.col("x").cast("string"))).alias("mux"), W.bits(F.col("v"), 7, 1).alias("bus"), (F.col("x").cast("long") * 1000).alias("delta_us"), err.alias("is_err"), F.lit("RECEIVE").alias("fmt"), F.when(err, W.hex_text(F.col("v"), 4)).otherwise("").alias("error_code"))
    rows = M.rows46(df, ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", M.csv_line(M.COLUMNS).alias("line"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The recorders of the events table merged, without duplicates, with gaps and in canonical order."""
    e = S.merge_key(S.collapse_exact(S.delta_per_file(events(spark, d)), list(S.KEY)))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("run_max").orderBy("file_idx", "seq")))
    out = S.canonical_order(e)
    return out.select("run_max", "place", "file_idx", "event_id", "rt", W.message_label(F.col("sa"), F.col("dir")).alias("msg"), W.delta_text(F.col("delta_us")).alias("delta"), W.error_label(F.col("is_err"), F.lit("")).alias("error"))
