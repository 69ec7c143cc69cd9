"""Helpers that the text operators share: the shared folder, written intermediates, skew-safe joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A key counts as hot when it holds this share of the rows, so at most its inverse of keys are hot.
HOT_SHARE = 0.002
HOT_LEAST = 50
#: At most about so many bytes of a batch, and so many rows, are Python objects at a time.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 512


class Cache(dict):
    """What a Python worker keeps between rows and tasks of one operator, in `most` bytes or a little more.

    hold() counts the bytes and empties the cache when they pass the bound. Another operator begins with empty caches."""

    every: weakref.WeakValueDictionary[int, Cache] = weakref.WeakValueDictionary()

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size = most, 0
        Cache.every[id(self)] = self

    def hold(self, key, value, size: int):
        if self.size > self.most:
            self.empty()
        self.size += size
        self[key] = value
        return value

    def empty(self) -> None:
        self.clear()
        self.size = 0


_operator = ""
#: Called when a worker begins with another operator: they let go of models and the like.
forgets: list[Callable[[], None]] = []


def trimmed() -> None:
    """Gives memory that isn't used back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def begun(operator: str) -> None:
    """A task of an operator begins. Workers are used again by later stages; what another operator kept goes first."""
    global _operator
    if operator != _operator:
        _operator = operator
        for c in list(Cache.every.values()):
            c.empty()
        for f in forgets:
            f()
        trimmed()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's spark.checkpoint.dir. Where that is unset and all runs on this machine, as in tests, one
    is made and set; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="busframe-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/busframe-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage is cut, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), which keeps the partitions and their order."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """docs with its columns renamed by place (c0, c1, ...) plus id and text, so that no column of docs can clash.

    The second value gives the columns of docs back under their own names."""
    names = docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = out.withColumns({"id": F.col(f"c{names.index('doc_id')}").cast("long"), "text": F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit(""))})
    return out, lambda df: [df[f"c{i}"].alias(n) for i, n in enumerate(names)]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE_BYTES, SLICE_ROWS at most and one row at least."""
    for batch in batches:
        n = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function that takes sliced batches and yields dicts of columns; each becomes a batch of the schema."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    operator = f.__module__

    def run(batches):
        begun(operator)
        for columns in f(sliced(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], type=x.type, from_pandas=False) for x in arrow], schema=arrow)
        trimmed()

    return df.mapInArrow(run, kind)


def pack_rows(rows: Iterator[tuple], names: list[str], size: int = 4096, heavy: int | None = None) -> Iterator[dict]:
    """Tuples gathered into dicts of columns of at most size rows; heavy: the place of a text or bytes whose lengths in
    a dict sum to little more than SLICE_BYTES."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        if heavy is not None:
            weight += len(row[heavy] or "")
        if len(held) >= size or weight >= SLICE_BYTES:
            yield dict(zip(names, zip(*held), strict=True))
            held, weight = [], 0
    if held:
        yield dict(zip(names, zip(*held), strict=True))


def join_by_hash(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: Column) -> DataFrame:
    """Left join on a binary or long key, where right has one row a key and in weight how many left rows have it.

    Keys with HOT_SHARE of all rows or more (at most 1 / HOT_SHARE of them) are broadcast, and their left rows
    are dealt out by spread; the others are joined by shuffle, where no key has more than that share."""
    most = max(HOT_LEAST, int(total * HOT_SHARE))
    others = [c for c in right.columns if c != key]
    hot = right.filter(F.col(weight) >= most).select(F.col(key), *[F.col(c).alias(f"hot_{c}") for c in others])
    cold = right.filter(F.col(weight) < most).select(F.col(key).alias("cold_key"), *others)
    left = left.join(F.broadcast(hot), key, "left")
    # A dealt key that happens to be another key's does no harm: what is hot comes first below.
    aside = F.xxhash64(spread) if dict(left.dtypes)[key] == "bigint" else F.concat(F.lit(b"\0"), F.sha2(spread.cast("string"), 256).cast("binary"))
    dealt = F.when(F.col(f"hot_{weight}").isNotNull(), aside).otherwise(F.col(key))
    out = left.withColumn("dealt_key", dealt).join(cold, F.col("dealt_key") == F.col("cold_key"), "left")
    return out.select(*[c for c in left.columns if not c.startswith("hot_")], *[F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in others])
