"""Reports of a recording's bytes, as lines in order."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from busframe.errors import RecordingEmpty, RecordingMissing, RecordingUnreadable
from busframe.functions import dump as D
from busframe.sources.recording import RecordingSource

log = logging.getLogger("busframe")
#: Bytes of a file that a row of the raw report's scan holds.
PIECE = 1 << 20


def opened(path: str) -> tuple[str, int]:
    """A recording's name and size; its typed error if there is nothing to report."""
    p = Path(path)
    if not p.exists():
        raise RecordingMissing(f"{path} doesn't exist", path=path)
    try:
        with p.open("rb"):
            size = p.stat().st_size
    except OSError as e:
        raise RecordingUnreadable(f"{path}: {e}", path=path) from e
    if not size:
        raise RecordingEmpty(f"{path} is empty", path=path)
    return p.name, size


def raw(spark: SparkSession, path: str, offset: int = 0, length: int | None = None) -> Iterator[str]:
    """The bytes of a window, 16 a line. Pieces of the window are read where they are rendered, at most PIECE bytes at a time."""
    name, size = opened(path)
    start = min(offset, size)
    end = max(start, size if length is None else min(start + length, size))
    yield f"File: {name} ({size} bytes)"
    yield f"Range: 0x{start:08X}-0x{end:08X}"
    yield ""
    pieces = -(-(end - start) // PIECE)

    def read(batches):
        import pyarrow as pa

        with open(path, "rb") as f:
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    f.seek(at := start + k * PIECE)
                    yield pa.RecordBatch.from_pydict({"base": [at], "data": [f.read(min(PIECE, end - at))]}, schema=pa.schema([("base", pa.int64()), ("data", pa.binary())]))

    if pieces:
        own = spark.range(0, pieces, 1, min(pieces, spark.sparkContext.defaultParallelism)).mapInArrow(read, "base long, data binary")
        each = own.select("base", F.explode(D.chunks(F.col("data"), F.lit(0), F.length("data"))).alias("c")).withColumn("at", F.col("base") + F.col("c.at"))
        # The range's partitions and their pieces are in order, and so are the lines.
        for r in each.select(D.hex_line(F.col("at"), F.col("c.part")).alias("line")).toLocalIterator():
            yield r["line"]


def records(spark: SparkSession, path: str, offset: int = 0, most: int | None = None) -> Iterator[str]:
    """A block of lines for each record, by lengths alone, until one is too short or passes the end."""
    name, size = opened(path)
    yield f"File: {name} ({size} bytes)"
    yield f"Record dump starting at offset 0x{offset:08X}"
    yield ""
    spark.dataSource.register(RecordingSource)
    options = {"paths": path, "walkOffset": offset} | ({} if most is None else {"walkRecords": most})
    df = spark.read.format(RecordingSource.name()).options(**options).load()
    n = 0
    # One file is one partition, whose rows come in order.
    for r in df.select("seq", "status", F.when(F.col("status").isNull(), D.record_block(F.col("seq"), F.col("offset"), F.col("w"))).alias("block")).toLocalIterator():
        if r["status"] is None:
            n += 1
            yield r["block"]
            yield ""
        elif r["status"]["outcome"] == "WORD_COUNT":
            log.warning("%s: invalid word_count at 0x%08X", path, r["status"]["offset"])
            yield f"  !! Invalid word_count={r['status']['raw']} at 0x{r['status']['offset']:08X}, stopping"
        elif r["status"]["outcome"] == "TRUNCATED":
            log.warning("%s: truncated record at 0x%08X", path, r["status"]["offset"])
            yield f"  !! Truncated record at 0x{r['status']['offset']:08X} ({r['status']['need']} bytes needed, {r['status']['have']} available)"
    yield D.RULE
    yield f"{n} records dumped."
