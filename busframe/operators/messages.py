"""From framed records to decoded messages: a composition of the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busframe.functions import words as W
from busframe.operators import classify as C
from busframe.operators import streams as S


def decode(frames: DataFrame, tick_rate_hz: float | None = None, mux_delimiter: str = ".", mux_field: int = 4) -> DataFrame:
    """Messages of frames (the schema of the recording source), rejected ones too (reject_reason).

    A spurious type comes before the error bit: such a record has no command and no error word. An errored record has
    its last word as error word, no status, and no structural checks. us is null where a counter has no rate."""
    w, ts = F.col("w"), F.col("ts_words")
    t, tw = W.irig(F.get(w, 1), F.get(w, 2), F.get(w, 3)), W.type_word(F.get(w, 0))
    df = frames.select("*", *[c.alias(k) for k, c in tw.items()], t["freerun"].alias("freerun_bit"), W.irig_us(t).alias("irig_us"), W.irig_text(t).alias("irig_text"))
    irig = F.col("ts_format") == "IRIG"
    ticks = F.shiftleft(F.get(w, 1).cast("long"), 16).bitwiseOR(F.get(w, 2).cast("long"))
    df = df.withColumn("std_raw", F.when(~irig, ticks)).withColumn("freerun", irig & F.col("freerun_bit"))
    # The rate decides the type: without one every clock value fits a long.
    us = F.when(irig, F.col("irig_us")) if tick_rate_hz is None else F.when(irig, F.col("irig_us").cast("decimal(20,0)")).otherwise(W.ticks_to_us(F.col("std_raw"), F.lit(float(tick_rate_hz))))
    df = df.withColumn("us", us).withColumn("time_stamp", F.when(irig, F.col("irig_text")).otherwise(W.standard_text(F.col("std_raw"))))
    df = df.withColumn("spurious", F.col("msg_type") == 0x20).withColumn("cmd", F.when(~F.col("spurious"), F.get(w, ts + 1)))
    c, c2 = W.command_word(F.col("cmd")), W.command_word(F.get(w, ts + 2))
    df = df.select("*", *[c[k].alias(k) for k in ("rt", "dir", "sa", "n")], c2["n"].alias("n2"), c2["dir"].alias("dir2"))
    df = df.withColumn("fmt", C.message_format(F.col("msg_type"), F.col("rt"), F.col("dir"), F.col("word_count"), ts))
    between = F.col("fmt").isin("RT_TO_RT", "RT_TO_RT_BROADCAST")
    errored = F.col("is_err") & ~F.col("spurious")
    normal = ~errored & ~F.col("spurious")
    own = C.payload(F.col("fmt"), w, ts + 2, F.when(between, F.col("n2")).otherwise(F.col("n")))
    rest = lambda at, n: F.slice(w, at + 1, F.greatest(F.lit(0), F.least(F.lit(32), n)))
    early = C.reject_reason(F.col("fmt"), F.col("dir"), F.col("n"), F.col("word_count"), ts)
    late = C.late_reject_reason(F.col("fmt"), F.col("dir2"), F.col("n"), F.col("n2"))
    df = df.withColumns({
        "reject_reason": F.when(normal, F.coalesce(early, late)),
        "status": F.when(normal, own["status"]),
        "cmd2": F.when(normal & between, F.get(w, ts + 2)),
        "status2": F.when(normal & (F.col("fmt") == "RT_TO_RT"), F.get(w, ts + 4 + F.col("n2"))),
        "error_word": F.when(errored, F.get(w, F.col("nwords") - 1)),
        "data_words": F.when(F.col("spurious"), rest(ts + 1, F.col("nwords") - 1 - ts)).when(errored, rest(ts + 2, F.col("nwords") - 3 - ts)).otherwise(own["data_words"]),
    })
    df = df.withColumn("anomalies", F.when(normal, C.anomalies(F.col("status"), F.col("rt"), F.col("reserved"))).otherwise(F.array().cast("array<string>")))
    df = S.spurious_code(df).withColumn("error_code", F.coalesce("code", W.hex_text(F.col("error_word"), 4), F.lit("")))
    return df.withColumn("mux", W.mux(F.col("file_name"), mux_delimiter, mux_field)).drop("freerun_bit", "irig_us", "irig_text", "code", "dir2", "n2", "w")


def accepted(messages: DataFrame) -> DataFrame:
    """Messages that no structural rule rejects, with delta_us within their file; spurious and untimed ones have none."""
    return S.timed_gaps(messages.filter("reject_reason is null"), S.delta_per_file)


def unknown_error(messages: DataFrame) -> Column:
    """Whether an errored message has an error word that no title is known for; its code stays as it is."""
    return F.coalesce(F.col("is_err") & ~F.col("spurious") & ~W.known_error(F.col("error_word")), F.lit(False))


def summary(messages: DataFrame) -> DataFrame:
    """A row a file: accepted and rejected messages, the first accepted one (lead: seq, ts_format, freerun), and the
    first that strict mode doesn't take (fault: seq, offset, reason)."""
    taken = F.col("reject_reason").isNull()
    reason = F.coalesce("reject_reason", F.when(unknown_error(messages), "UNKNOWN_ERROR_CODE"))
    return messages.groupBy("file_idx", "path").agg(
        F.count_if(taken).alias("accepted"), F.count_if(~taken).alias("rejected"),
        F.min(F.when(taken, F.struct("seq", "ts_format", "freerun"))).alias("lead"),
        F.min(F.when(reason.isNotNull(), F.struct("seq", "offset", reason.alias("reason")))).alias("fault"),
    )


def events(messages: DataFrame) -> DataFrame:
    """What is worth telling of each file's messages: event, how often, and the offset of the first.

    Events are the reasons of rejects and anomalies, unknown error codes, freerunning clocks, and the advice that days of
    an absolute clock depend on the recorder's firmware (once a file)."""
    day = F.when((F.col("ts_format") == "IRIG") & ~F.col("freerun"), F.lit("CLOCK_DAY"))
    own = F.array(F.col("reject_reason"), F.when(unknown_error(messages), "UNKNOWN_ERROR_CODE"), F.when(F.col("freerun"), "FREERUN"), day)
    each = messages.select("file_idx", "path", "offset", F.explode(F.array_compact(F.concat(own, F.when(F.col("reject_reason").isNull(), F.col("anomalies")).otherwise(F.array().cast("array<string>"))))).alias("event"))
    counted = each.groupBy("file_idx", "path", "event").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))
    return counted.withColumn("n", F.when(F.col("event") == "CLOCK_DAY", 1).otherwise(F.col("n")).cast("long"))


#: What makes two messages the same on the wire.
CONTENT = ["msg_type", "bus", "word_count", "is_err", "cmd", "cmd2", "status", "status2", "error_word", "data_words"]

COLUMNS = ["TIME_STAMP", "RT", "MSG", *[f"WD{k:02d}" for k in range(1, 33)], "STAT", "CMD", "MUX", "TERM_NAME", "BUS", "DELTA", "IM_GAP", "RCV_GAP", "XMT_GAP", "ERROR", "ERROR_CODE"]


def _hex(c: Column) -> Column:
    return F.coalesce(W.hex_text(c, 4), F.lit(""))


def rows46(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 46 text columns of messages, after the columns in keep."""
    blank = F.lit("")
    own = {f"WD{k + 1:02d}": _hex(F.get("data_words", F.lit(k))) for k in range(32)} | {
        "TIME_STAMP": F.col("time_stamp"), "RT": F.coalesce(F.col("rt").cast("string"), blank), "MSG": F.coalesce(W.message_label(F.col("sa"), F.col("dir")), blank), "STAT": _hex(F.col("status")),
        "CMD": _hex(F.col("cmd")), "MUX": F.coalesce("mux", blank), "BUS": F.when(F.col("bus") == 0, "A").otherwise("B"), "DELTA": W.delta_text(F.col("delta_us")),
        "ERROR": W.error_label(F.col("is_err"), F.col("fmt")), "ERROR_CODE": F.col("error_code"),
    }
    return df.select(*(keep or []), *[own.get(c, blank).alias(c) for c in COLUMNS])


def csv_line(columns: list[str]) -> Column:
    """One line; a field is quoted only if it holds a comma, a quote or a line break."""
    quoted = lambda c: F.when(F.col(c).rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return F.concat_ws(",", *[quoted(c) for c in columns])
