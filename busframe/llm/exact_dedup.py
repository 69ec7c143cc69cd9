"""Exact deduplication over an extendible-hash index kept in shared files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busframe.llm.common import join_by_hash, map_rows, pack_rows, plain, shared_folder

#: Runs of ASCII white space but for single spaces, which the normal form leaves alone.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BUCKET = 64
FLUSH_BYTES = 8 << 20
SLOTS_PER_TASK = 16
#: Of the docs' size, about so much goes to a slot at most, and to a task.
SLOT_BYTES = 4 << 20
TASK_BYTES = 64 << 20
#: A directory doubles so often at most; buckets as deep as that chain what they can't hold.
DEEPEST = 14
INDEX = "slot int, bucket string, depth int, h long, chain int, sha binary, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


class Entry:
    """A text of the index: its key, place in the key's chain, bytes, smallest id and number of rows."""

    __slots__ = ("key", "chain", "text", "keep", "rows")

    def __init__(self, key: int, chain: int, text: bytes):
        self.key, self.chain, self.text, self.keep, self.rows = key, chain, text, None, 0


class Directory:
    """Extendible hashing over 64-bit keys: the leading bits choose a directory entry, which names a bucket.

    A bucket that would pass its capacity splits by its next bit. If it is as deep as the directory, the directory
    doubles first. Keys that agree in all the bits of the deepest directory stay chained in one bucket."""

    def __init__(self, capacity: int = BUCKET, skip: int = 0):
        self.capacity, self.skip, self.depth = capacity, skip, 0
        self.entries: list[list] = [[0, 0, {}]]  # of each: prefix, local depth, chains by key

    def _place(self, key: int, depth: int) -> int:
        return (key >> (64 - self.skip - depth)) & ((1 << depth) - 1)

    def _bucket(self, key: int) -> list:
        return self.entries[self._place(key, self.depth)]

    def find(self, key: int, text: bytes) -> Entry | None:
        """The entry of a text: the key names a bucket, the bucket holds the key's chain, and bytes are compared along it."""
        for entry in self._bucket(key)[2].get(key, ()):
            if entry.text == text:
                return entry
        return None

    def insert(self, key: int, text: bytes) -> Entry:
        """A new entry at the end of the key's chain."""
        bucket = self._bucket(key)
        chain = bucket[2].setdefault(key, [])
        chain.append(entry := Entry(key, len(chain), text))
        while len(bucket[2]) > self.capacity and bucket[1] < min(DEEPEST, 64 - self.skip):
            if bucket[1] == self.depth:
                self.entries = [b for b in self.entries for _ in (0, 1)]
                self.depth += 1
            prefix, depth, chains = bucket
            halves = [[prefix << 1 | side, depth + 1, {k: x for k, x in chains.items() if self._place(k, depth + 1) == prefix << 1 | side}] for side in (0, 1)]
            width = self.depth - depth - 1
            for side, half in enumerate(halves):
                first = (prefix << 1 | side) << width
                self.entries[first : first + (1 << width)] = [half] * (1 << width)
            bucket = max(halves, key=lambda b: len(b[2]))
        return entry

    def buckets(self):
        seen = set()
        for b in self.entries:
            if id(b) not in seen:
                seen.add(id(b))
                yield b


def _gather(batches):
    """One row for each text of a partition (or of FLUSH_BYTES of it): hash, text, smallest id, rows."""
    held: dict[str, list] = {}
    size = 0
    names = ["h", "text", "keep_id", "n"]
    flush = lambda: pack_rows(((h, t, i, n) for t, (h, i, n) in held.items()), names, 2048, heavy=1)
    for batch in batches:
        for h, t, i in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), batch.column("id").to_pylist(), strict=True):
            x = held.get(t)
            if x is None:
                held[t] = [h, i, 1]
                size += len(t)
            else:
                x[2] += 1
                if i is not None and (x[1] is None or i < x[1]):
                    x[1] = i
        if size > FLUSH_BYTES:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def _owner(bits: int, capacity: int):
    def run(batches):
        """Rows come sorted by slot, the leading bits of the hash. A slot has a directory of its own, in which each row
        finds its text's entry or makes one; when the slot is through, its buckets are written."""

        def rows():
            slot, directory = None, None

            def done():
                for prefix, depth, chains in directory.buckets():
                    name = f"{prefix:0{depth}b}" if depth else ""
                    for key, chain in chains.items():
                        for x in chain:
                            yield slot, name, depth, key - (1 << 64 if key >> 63 else 0), x.chain, hashlib.sha256(x.text).digest(), x.keep, x.rows

            for batch in batches:
                for h, t, i, n in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "keep_id", "n")), strict=True):
                    key, text = h & (1 << 64) - 1, t.encode("utf-8", "surrogatepass")
                    if key >> (64 - bits) != slot:
                        if directory:
                            yield from done()
                        slot, directory = key >> (64 - bits), Directory(capacity, bits)
                    x = directory.find(key, text) or directory.insert(key, text)
                    x.rows += n
                    if i is not None and (x.keep is None or i < x.keep):
                        x.keep = i
            if directory:
                yield from done()

        yield from pack_rows(rows(), ["slot", "bucket", "depth", "h", "chain", "sha", "keep_id", "group_size"])

    return run


def build_index(docs: DataFrame, capacity: int = BUCKET) -> DataFrame:
    """The index of docs (id, text), written to the shared folder: one row for each distinct normalised text.

    Each map task hands on a text once, so that a group of copies of any size is a row a task. The leading bits of
    the hash are the slots of the first directory; each task owns some of these key ranges and grows a directory for
    each, in which texts are looked up and compared byte by byte. A task holds one slot's texts, about SLOT_BYTES:
    the number of slots follows the size that the plan has for docs, that of tasks with it and never below
    spark.sql.shuffle.partitions, of which adaptive execution joins the small ones."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = min(size, 1 << 60)  # a plan without statistics has the largest long
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(30, max(1, (max(tasks * SLOTS_PER_TASK, size // SLOT_BYTES if size < 1 << 60 else 0) - 1).bit_length()))
    norm = docs.select("id", normalised(F.col("text")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = map_rows(norm, _gather, "h long, text string, keep_id long, n long").withColumn("slot", F.shiftrightunsigned("h", 64 - bits))
    wanted = size // TASK_BYTES if size < 1 << 60 else 0
    dealt = (rows.repartition(wanted, "slot") if wanted > tasks else rows.repartition("slot")).sortWithinPartitions("slot").drop("slot")
    path = shared_folder(spark, "exact-index")
    map_rows(dealt, _owner(bits, capacity), INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def directory(index: DataFrame) -> DataFrame:
    """The buckets of an index with their depths and fill."""
    return index.groupBy("slot", "bucket", "depth").agg(F.count("*").alias("entries"), F.max("chain").alias("longest_chain"))


def exact_dedup(docs: DataFrame, carry: bool = True) -> DataFrame:
    """docs (doc_id, text and any others) with keep_id, group_size, kept and text_sha256 of the normalised text.

    Texts are equal if identical after each run of ASCII white space became one space. The row with a group's
    smallest doc_id stays. A null text is an empty text; empty texts are one group. A null doc_id is larger than
    any other; a group of null ids alone keeps them all (keep_id null). Rows that share the smallest doc_id are
    statements of one document and stay together. An empty table gives no rows. carry: return the columns of docs
    as a struct `row` beside those; else doc_id only."""
    base, own = plain(docs)
    index = build_index(base.select("id", "text"))
    total = index.agg(F.sum("group_size")).first()[0] or 0
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    left = base.select(F.struct(*own(base)).alias("row") if carry else F.struct(F.col("id").alias("doc_id")).alias("row"), "id", sha.alias("sha"))
    out = join_by_hash(left, index.filter("group_size > 1").select("sha", "keep_id", "group_size"), "sha", "group_size", total, F.col("id"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select("row", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops."""
    return exact_dedup(docs).filter("kept").select("row.*")
