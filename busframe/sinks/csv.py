"""One CSV file of ordered rows, or two with errors apart; or lines to a stream.

Executors write sorted parts to the folder that they share with the driver (spark.checkpoint.dir; where it is unset, beside
the destination, which only serves a single machine). The driver joins the parts' bytes, checks that all have
come, and renames the result, so a failed run leaves nothing behind."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from busframe.errors import OutputExists, OutputIsInput, WriteFailed
from busframe.operators.messages import COLUMNS, csv_line

HEADER = ",".join(COLUMNS)


def errors_path(path: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}_errors{p.suffix}"))


def preflight(path: str, inputs: list[str] = (), no_clobber: bool = False, separate: bool = False) -> None:
    for out in [path, errors_path(path)] if separate else [path]:
        if any(os.path.realpath(out) == os.path.realpath(x) for x in inputs):
            raise OutputIsInput(f"{out} is one of the inputs", path=out)
        if no_clobber and os.path.exists(out):
            raise OutputExists(f"{out} is there already", path=out)


def _staged(df: DataFrame, order: list[str], path: str, always: bool) -> str | None:
    """A finished temporary file beside path, or null if there is no row and none is asked for."""
    spark = df.sparkSession
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    name = uuid.uuid4().hex
    stage, shared = f"{path}.{name}", sc.getConf().get("spark.checkpoint.dir")
    folder = f"{shared}/csv-{name}" if shared else f"file://{os.path.abspath(stage)}.parts"
    at = jvm.org.apache.hadoop.fs.Path(folder)
    conf = sc._jsc.hadoopConfiguration()
    fs = at.getFileSystem(conf)
    try:
        seen = Observation()
        lines = df.orderBy(*order).select(csv_line(COLUMNS).alias("value"))
        lines.observe(seen, F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).write.text(folder)
        size = seen.get["bytes"]
        if not always and not size:
            return None
        parts = sorted(x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))
        with open(stage, "wb") as out:
            out.write(f"{HEADER}\n".encode())
        out = jvm.java.io.FileOutputStream(stage, True)
        try:
            for p in parts:
                own = fs.open(jvm.org.apache.hadoop.fs.Path(p))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, conf, False)
                finally:
                    own.close()
        finally:
            out.close()
        if (got := os.path.getsize(stage) - len(HEADER) - 1) != size:
            raise WriteFailed(f"{path}: {got} of {size} bytes came from the executors; do they share {folder} with the driver?", path=path)
        return stage
    except OSError as e:
        Path(stage).unlink(missing_ok=True)
        raise WriteFailed(f"{path}: {e}", path=path) from e
    except BaseException:
        Path(stage).unlink(missing_ok=True)
        raise
    finally:
        fs.delete(at, True)


def write(rows: DataFrame, order: list[str], path: str, separate: bool = False, partial: bool = False) -> list[str]:
    """Writes rows (order columns and the 46 columns); returns the files made. With separate, rows with an ERROR go to
    their own file, made only if there are any. A partial result has .partial behind its names."""
    clean = rows.filter(F.col("ERROR") == "") if separate else rows
    staged = [(path, _staged(clean, order, path, True))]
    if separate:
        apart = errors_path(path)
        try:
            staged.append((apart, _staged(rows.filter(F.col("ERROR") != ""), order, apart, False)))
        except BaseException:
            Path(staged[0][1]).unlink(missing_ok=True)
            raise
    out = []
    for to, stage in staged[::-1] if partial else staged:
        if stage:
            os.replace(stage, to + ".partial" * partial)
            out.append(to + ".partial" * partial)
    return out


def lines(rows: DataFrame, order: list[str]) -> Iterator[str]:
    """The header and a line for each row, in order; the driver holds a partition at a time."""
    yield HEADER
    for r in rows.orderBy(*order).select(csv_line(COLUMNS).alias("value")).toLocalIterator():
        yield r["value"]
