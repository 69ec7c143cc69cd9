"""The whole way from recordings to ordered rows, counts and files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from busframe import errors as E
from busframe.config import Settings
from busframe.operators import messages as M
from busframe.operators import streams as S
from busframe.sinks import csv
from busframe.sources.recording import RecordingSource

IncompatibleInputs = E.IncompatibleInputs
ORDER = ["run", "chunk", "place"]


def scan(spark: SparkSession, paths: list[str], s: Settings = Settings()) -> DataFrame:
    """Frames of recordings, and a row with a status behind those of each file."""
    spark.dataSource.register(RecordingSource)
    options = {"paths": "\n".join(paths), "timeFormat": s.time_format, "detectRecords": s.detect_records, "lookaheadRecords": s.lookahead_records, "strict": s.strict}
    return spark.read.format(RecordingSource.name()).options(**options).load()


def statuses(scanned: DataFrame) -> DataFrame:
    """A row a file: how it ended, its size and records, and what the clock's probe found."""
    return scanned.filter("status is not null").select("file_idx", "path", "file_len", "status.*")


def decoded(scanned: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All messages of scanned files, rejected ones too."""
    df = M.decode(scanned.filter("status is null").drop("status"), s.standard_tick_rate_hz, s.mux_delimiter, s.mux_field)
    return df if s.mux_enabled else df.withColumn("mux", F.lit(None).cast("string"))


def read(spark: SparkSession, paths: list[str], s: Settings = Settings()) -> DataFrame:
    """Accepted messages of recordings, with gaps per file; order is in file_idx and seq. How files ended isn't looked at."""
    return M.accepted(decoded(scan(spark, paths, s), s))


def mergeable(lead: Row | None, path: str) -> E.IncompatibleInputs | None:
    """The error that a recording's first message is in a merge if it has no absolute clock."""
    if lead is not None and (lead["ts_format"] != "IRIG" or lead["freerun"]):
        return E.IncompatibleInputs(f"{path} has no absolute clock" + " (freerun)" * bool(lead["freerun"]), path=path)
    return None


@dataclass
class Decoding:
    """Messages to put out, ordered by run, chunk, place, and what is known of the files they are from.

    lost is the error that ended a recording early while the rows before it are good, or null. Close it when the rows
    are written."""

    rows: DataFrame
    statuses: list[Row]
    counts: dict[int, Row]
    lost: E.BusframeError | None = None
    dropped: list[E.BusframeError] = field(default_factory=list)
    messages: DataFrame | None = None
    before: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)

    def hold(self, df: DataFrame) -> DataFrame:
        """df, kept in memory or on disk until this closes. What follows uses it several times, as operators that go by
        blocks do, and neither works it out again nor plans it again."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def __enter__(self) -> Decoding:
        return self

    def __exit__(self, *_) -> None:
        for df in self.held:
            df.unpersist()

    @property
    def sync_losses(self) -> int:
        return sum(r["losses"] or 0 for r in self.statuses)

    @property
    def ended(self) -> str:
        """Of the whole run: partial-unrecoverable, empty-recording, partial-recovered or complete."""
        if self.lost or self.dropped:
            return "partial-unrecoverable"
        if all(r["outcome"] == "EMPTY_RECORDING" for r in self.statuses):
            return "empty-recording"
        return "partial-recovered" if self.sync_losses else "complete"

    def tally(self) -> dict[str, int]:
        """Messages accepted, rejected, collapsed as duplicates, excluded by filters and put out, and losses of sync."""
        accepted = sum(c["accepted"] for c in self.counts.values())
        merged, out = self.before.count(), self.rows.count()
        return {"accepted": accepted, "rejected": sum(c["rejected"] for c in self.counts.values()), "collapsed": accepted - merged, "excluded": merged - out, "out": out, "sync_losses": self.sync_losses}


def ends(files: list[Row], counts: dict[int, Row], strict: bool) -> dict[int, tuple[E.BusframeError, bool]]:
    """Of each file that ends with an error: the error, and whether no message was accepted before it.

    In strict mode the first message that breaks a rule comes before what ended the framing behind it."""
    out = {}
    for f in files:
        error = E.of_outcome(f["path"], f["outcome"], offset=f["offset"], raw=f["raw"], need=f["need"], have=f["have"], losses=f["losses"], irig=f["irig"], standard=f["standard"], probed=f["probed"])
        c = counts.get(f["file_idx"])
        none = c is None or not c["accepted"]
        if strict and c is not None and c["fault"] is not None:
            fault = c["fault"]
            kind = E.UnknownErrorCode if fault["reason"] == "UNKNOWN_ERROR_CODE" else E.BadRecord
            error = kind(f"{f['path']}: {fault['reason'].lower().replace('_', ' ')} at offset {fault['offset']}", path=f["path"], offset=fault["offset"], reason=fault["reason"])
            none = none or c["lead"]["seq"] > fault["seq"]
        if error:
            out[f["file_idx"]] = (error, none)
    return out


def decode(spark: SparkSession, paths: list[str], s: Settings = Settings()) -> Decoding:
    """Reads recordings once, decides by how they ended, and merges, collapses, filters and orders their messages.

    What can't be read raises its error, the first in file order. With allow_partial a file of a merge that can't be
    opened, or gives no message before its error, is left out. A recording that is lost in the middle keeps the
    messages before that, and the error is handed on in `lost`."""
    out = Decoding(spark.range(0), [], {})
    scanned = out.hold(scan(spark, paths, s))
    try:
        out.statuses = statuses(scanned).orderBy("file_idx").collect()  # a row a file, at most 256; so are the counts
        out.messages = out.hold(decoded(scanned, s))
        out.counts = {r["file_idx"]: r for r in M.summary(out.messages).collect()}
        failed, merge, left_out = ends(out.statuses, out.counts, s.strict), len(paths) > 1, set()
        for f in sorted(out.statuses, key=lambda f: (not f["outcome"].startswith("OPEN_"), f["file_idx"])):
            k = f["file_idx"]
            error, first = failed.get(k, (None, False))
            if error and (first or not isinstance(error, E.SyncLost)):
                if merge and s.allow_partial and first:
                    out.dropped.append(error)
                    left_out.add(k)
                    continue
                if not isinstance(error, E.SyncLost) and (first or not merge):
                    raise error
                if merge and first:
                    raise error
            if merge and k in out.counts and (odd := mergeable(out.counts[k]["lead"], f["path"])):
                raise odd
        late = [e for k, (e, _) in sorted(failed.items()) if k not in left_out]
        for error in late:
            if not isinstance(error, E.SyncLost):
                raise error
        out.lost = late[0] if late else None
        df = out.hold(M.accepted(out.messages))
        if left_out:
            df = df.filter(~F.col("file_idx").isin(*left_out))
        if merge:
            if s.strict and (back := S.file_backward(df).orderBy("file_idx").first()):
                path = paths[back["file_idx"]]
                raise E.NotMonotonic(f"{path} is not internally time-sorted", path=path, index=back["file_idx"], before=back["before"], us=back["us"])
            if s.collapse_duplicates:
                steady = not s.collapse_window_us and S.file_backward(df).isEmpty()
                df = S.collapse_exact(df, M.CONTENT) if steady else S.collapse_window(df, M.CONTENT, s.collapse_window_us)
            df = out.hold(S.positions(df))
            if s.delta_scope == "global":
                df = S.timed_gaps(df.drop("delta_us"), S.delta_global)
        else:
            df = df.withColumn("pos", F.col("seq"))
        out.before = df = out.hold(df) if merge else df
        df = S.keep_messages(df, s.exclude, s.include)
        # Without a rate the counter itself tells ties.
        df = df.withColumnsRenamed({"us": "clock_us"}).withColumn("us", F.coalesce("clock_us", F.col("std_raw")))
        out.rows = S.canonical_order_any(df, s.max_sort_group).drop("us").withColumnRenamed("clock_us", "us")
        return out
    except BaseException:
        out.__exit__()
        raise


def stream(spark: SparkSession, paths: list[str], s: Settings = Settings()) -> DataFrame:
    """Messages to put out, ordered by run, chunk, place. A recording that is lost in the middle raises, but with allow_partial."""
    out = decode(spark, paths, s)
    if out.lost and not s.allow_partial:
        out.__exit__()
        raise out.lost
    return out.rows


def count(spark: SparkSession, path: str, s: Settings = Settings()) -> int:
    """Accepted messages of a recording after the filters. All errors raise, also the loss of a recording in the middle."""
    out = decode(spark, [path], s)
    with out:
        if out.lost:
            raise out.lost
        return S.keep_messages(out.messages.filter("reject_reason is null"), s.exclude, s.include).count()


def diagnostics(out: Decoding) -> DataFrame:
    """file_idx, path, event, n, first_offset: the messages' events and, for files, backward steps of keys, losses of sync,
    unclear clocks and odd ends; in a merge also files that step backward (FILE_BACKWARD)."""
    rows = M.events(out.messages)
    accepted, names = out.messages.filter("reject_reason is null"), F.broadcast(statuses(out.held[0]).select("file_idx", "path"))  # a row a file
    back = S.backward_steps(accepted).join(names, "file_idx")
    steps = back.groupBy("file_idx", "path").agg(F.sum("steps").alias("n")).select("file_idx", "path", F.lit("KEY_BACKWARD").alias("event"), "n", F.lit(None).cast("long").alias("first_offset"))
    files = statuses(out.held[0])
    own = F.array(
        F.struct(F.lit("SYNC_LOSS").alias("event"), F.col("losses").alias("n")), F.struct(F.concat(F.lit("CLOCK_"), "clock").alias("event"), F.when(F.col("clock") != "OK", 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.col("outcome").alias("event"), F.when(F.col("outcome") != "OK", 1).otherwise(0).cast("long").alias("n")),
    )
    ended = files.select("file_idx", "path", F.explode(own).alias("x"), F.col("offset").alias("first_offset")).filter("x.n > 0").select("file_idx", "path", "x.event", "x.n", "first_offset")
    if len(out.statuses) > 1:
        unsorted = S.file_backward(accepted).join(names, "file_idx")
        ended = ended.unionByName(unsorted.select("file_idx", "path", F.lit("FILE_BACKWARD").alias("event"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("first_offset")))
    return rows.unionByName(steps).unionByName(ended)


def to_csv(spark: SparkSession, paths: list[str], out: str, s: Settings = Settings()) -> list[str]:
    """Writes the messages of recordings to a CSV file, with errors apart if asked for; the files made."""
    apart = s.error_mode == "separate"
    csv.preflight(out, paths, s.no_clobber, apart)
    with decode(spark, paths, s) as found:
        if found.lost and not s.allow_partial:
            raise found.lost
        return csv.write(M.rows46(found.rows, ORDER), ORDER, out, apart, bool(found.lost or found.dropped))
