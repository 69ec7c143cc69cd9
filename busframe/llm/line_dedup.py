"""Line deduplication by range-partitioned line hashes, returning keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busframe.llm.common import ASCII_SPACE, checkpointed, map_rows, pack_rows, plain, written

LEAST_CHARS = 20
LEAST_DOCS = 3
ENTRY = "hi long, lo long, id long, th long, pos int"
HALF = 1 << 63


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(ASCII_SPACE).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _entries(least: int):
    def run(batches):
        def rows():
            for batch in batches:
                for i, th, text in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for pos, line in enumerate(text.split("\n")):
                        if len(line) >= least and len(line := line.strip(ASCII_SPACE)) >= least:
                            h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass").lower())
                            yield (h >> 64) - HALF, (h & 2**64 - 1) - HALF, i, th, pos

        yield from pack_rows(rows(), ["hi", "lo", "id", "th", "pos"])

    return run


def _stream(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "id", "th", "pos")), strict=True)


SUMMARY = "pid int, first_hi long, first_lo long, first_docs long, first_top long, first_end long, last_hi long, last_lo long, last_docs long, last_top long, last_end long, one boolean"


def _summary(batches):
    """Of a partition: its first and last run of equal hashes, with their distinct ids, largest id and last id."""
    first = None
    run, docs, top, end = None, 0, None, None
    for hi, lo, i, _, _ in _stream(batches):
        if (hi, lo) != run:
            if run is not None and first is None:
                first = (*run, docs, top, end)
            run, docs, top, end = (hi, lo), 1, i, i
        elif i != end:
            docs, end = docs + 1, i
    if run is not None:
        last = (*run, docs, top, end)
        row = (TaskContext.get().partitionId(), *(first or last), *last, first is None)
        yield dict(zip((x.split()[0] for x in SUMMARY.split(", ")), ([v] for v in row), strict=True))


def stitched(rows: list) -> dict[int, tuple]:
    """For each partition, of its first and of its last run over all partitions: distinct ids and largest id."""
    out: dict[int, list] = {}
    group, docs, top, end, key = [], 0, None, None, None

    def close():
        for pid, side in group:
            out.setdefault(pid, [None, None])[side] = (docs, top)

    for r in sorted(rows, key=lambda r: r["pid"]):
        for side, name in enumerate(("first", "last")):
            if side and r["one"]:
                group.append((r["pid"], 1))
                continue
            now = (r[f"{name}_hi"], r[f"{name}_lo"])
            if group and now == key:
                docs += r[f"{name}_docs"] - (r[f"{name}_top"] == end)
            else:
                close()
                group, key, docs, top = [], now, r[f"{name}_docs"], r[f"{name}_top"]
            end = r[f"{name}_end"]
            group.append((r["pid"], side))
    close()
    return {k: tuple(v) for k, v in out.items()}


def _dropped(edges: dict, ends: dict, least: int):
    """edges: of each partition its stitched runs; ends: the hashes of these runs."""

    def run(batches):
        pid = TaskContext.get().partitionId()
        first, last = edges.get(pid, (None, None))
        first_key, last_key = ends.get(pid, (None, None))

        def rows():
            at, docs, top, end, known, held = None, 0, None, None, None, []
            for hi, lo, i, th, pos in _stream(batches):
                if (hi, lo) != at:
                    at, held = (hi, lo), []
                    known = first if at == first_key else last if at == last_key else None
                    docs, top, end = 1, known[1] if known else i, i
                elif i != end:
                    docs, end = docs + 1, i
                    if known is None and docs == least:
                        yield from held
                        held = []
                if i != top:
                    if known[0] >= least if known else docs >= least:
                        yield i, th, pos
                    elif not known:
                        held.append((i, th, pos))

        yield from pack_rows(rows(), ["id", "th", "pos"])

    return run


def _bitmaps(batches):
    """Keep bitmaps: bit p of the unpacked bytes is 1 if line p stays; lines past the end stay."""
    for batch in batches:
        ids, ths, drops = (batch.column(c).to_pylist() for c in ("id", "th", "drops"))
        maps = []
        for d in drops:
            bits = np.ones(max(d) + 1, np.uint8)
            bits[d] = 0
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        yield {"id": ids, "th": ths, "last": [max(d) for d in drops], "n_dropped": [len(d) for d in drops], "bitmap": maps}


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """For docs (id, th, text), each text that loses lines: id, th, last (dropped line), n_dropped, bitmap.

    Line hashes are range-partitioned together with document and position, so that a line of any frequency spreads
    over as many partitions as it needs. Each partition's first and last run are summed up in one row; the driver
    stitches these few rows, and a second pass streams the sorted entries and gives the occurrences that go.
    least_docs must be at least 2. Lines are told apart by 128-bit hashes."""
    spark = docs.sparkSession
    entries = written(map_rows(docs, _entries(least_chars), ENTRY), "line-entries")
    order = [F.col("hi"), F.col("lo"), F.col("id").desc_nulls_last(), F.col("th"), F.col("pos")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(entries.repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    found = map_rows(ranged, _summary, SUMMARY).collect()  # a row a partition
    ends = {r["pid"]: ((r["first_hi"], r["first_lo"]), (r["last_hi"], r["last_lo"])) for r in found}
    gone = map_rows(ranged, _dropped(stitched(found), ends, least_docs), "id long, th long, pos int")
    drops = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))
    return map_rows(drops, _bitmaps, "id long, th long, last int, n_dropped long, bitmap binary")


def _kept(bitmap: bytes | None, last: int | None, lines: list[str]) -> list[str]:
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: last + 1]
    return [x for k, x in enumerate(lines) if k > last or bits[k]]


def _digests(batches):
    for batch in batches:
        n_lines, n_dropped, shas = [], [], []
        for text, bitmap, last in zip(*(batch.column(c).to_pylist() for c in ("text", "bitmap", "last")), strict=True):
            lines = text.split("\n")
            stay = _kept(bitmap, last, lines)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            shas.append(hashlib.sha256("\n".join(stay).encode("utf-8", "surrogatepass")).hexdigest())
        yield {"doc_id": batch.column("id").to_pylist(), "n_lines": n_lines, "n_dropped": n_dropped, "kept_sha256": shas}


def _texts(batches):
    for batch in batches:
        stay = ["\n".join(_kept(b, k, t.split("\n"))) for t, b, k in zip(*(batch.column(c).to_pylist() for c in ("text", "bitmap", "last")), strict=True)]
        yield {"doc_id": batch.column("id").to_pylist(), "text": stay}


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, texts: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of docs; with texts, doc_id and the text that stays.

    Lines whose key (ends stripped, A-Z lowered) has least_chars code points or more and stands in least_docs
    documents or more go from all of them but the largest doc_id. A null or empty text is one empty line. A null
    doc_id is one document, smaller than all others. Rows that share a doc_id are one document in the count and
    each keep or lose their own lines. Repeats within the largest document stay. An empty table gives no rows."""
    base = plain(docs)[0].select("id", "text").withColumn("th", F.xxhash64("text"))
    maps = keep_bitmaps(base, least_chars, least_docs)
    right = maps.select(F.col("id").alias("rid"), F.col("th").alias("rth"), "last", "bitmap")
    joined = base.join(right, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left").select("id", "text", "last", "bitmap")
    if texts:
        return map_rows(joined, _texts, "doc_id long, text string")
    return map_rows(joined, _digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
