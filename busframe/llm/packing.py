"""Best-fit packing of tokenised documents into sequences, under several capacities at once."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busframe.llm.byte_ids import byte_ids
from busframe.llm.common import map_rows, pack_rows, plain, written

SEQUENCE = 1024
END_ID = 2


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most: tokens, pieces, and attention cost (the sum over pieces of length squared, in
    units of `tokens`, rounded up). By default only the tokens bind, as the fewest sequences ask for."""

    tokens: int = SEQUENCE
    documents: int = SEQUENCE
    attention: int = SEQUENCE
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05)
    rule: str = "residual"

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, -(-length * length // self.tokens)])

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention])


@dataclass
class Plan:
    """Where the pieces of a length go by their rank: those from ranks[k] on to sequences from bins[k] on, at offsets[k]."""

    steps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    n_bins: int

    def place(self, length: int, rank: int) -> tuple[int, int]:
        ranks, bins, offsets = self.steps[length]
        k = int(np.searchsorted(ranks, rank, "right")) - 1
        return int(bins[k] + rank - ranks[k]), int(offsets[k])


def best_fit(counts: dict[int, int], cap: Capacities = Capacities()) -> Plan:
    """Packs counts[length] pieces of each length, longest first.

    Pieces of a length are alike, and so are sequences with the same residual capacities; so whole runs of both are
    matched at once, and work and plan depend on the number of lengths and not on that of pieces. For the next
    piece, of the open sequences that hold it under every capacity, the rule takes the one whose residual vector
    after it has the least weighted norm ("residual"), or whose residual has the largest weighted dot product with
    the demand ("dot"); at a tie the first opened."""
    full, weights = cap.vector, np.array(cap.weights)
    open_runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    keys = np.zeros((0, 3), np.int64)
    steps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    n_bins = 0
    for length in sorted(counts, reverse=True):
        left, rank, need = counts[length], 0, cap.demand(length)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens passes a capacity")
        while left:
            after = keys - need
            fits = (after >= 0).all(axis=1) if len(keys) else np.zeros(0, bool)
            if fits.any():
                score = ((after / full) ** 2 * weights).sum(axis=1) if cap.rule == "residual" else -((keys / full) * (need / full) * weights).sum(axis=1)
                at = int(np.argmin(np.where(fits, score, np.inf)))
                key = tuple(keys[at].tolist())
                runs = open_runs[key]
                start, n = runs[0]
                m = min(n, left)
                if m == n:
                    runs.pop(0)
                    if not runs:
                        del open_runs[key]
                        keys = np.delete(keys, at, axis=0)
                else:
                    runs[0] = (start + m, n - m)
                offset = int(full[0] - key[0])
            else:
                each = int((full // need).min())
                m, copies = (left // each, each) if left >= each else (1, left)
                start = n_bins
                n_bins += m
                for k in range(copies - 1):
                    steps[length].append((rank, start, k * length))
                    rank, left = rank + m, left - m
                key, offset = tuple((full - (copies - 1) * need).tolist()), (copies - 1) * length
            steps[length].append((rank, start, offset))
            rank, left = rank + m, left - m
            new = tuple((np.array(key) - need).tolist())
            if new[0] > 0 and new[1] > 0:
                if new not in open_runs:
                    open_runs[new] = []
                    keys = np.vstack([keys, new])
                open_runs[new].append((start, m))
    return Plan({k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in steps.items()}, n_bins)


TOKENISED = "pid int, id long, n long, first int, rank long, full long, crcs array<long>, ids binary"


def _tokenise(size: int, vocabulary: str | None, keep_ids: bool):
    """Of each document: tokens, length of its first piece, its rank among the partition's equal first pieces, the
    number of whole pieces before it in the partition, and the pieces' checksums."""

    def run(batches):
        own, pid = byte_ids(vocabulary), TaskContext.get().partitionId()
        seen: Counter = Counter()

        def rows():
            whole = 0
            for batch in batches:
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = own.encode(text) + END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    first = (n - 1) % size + 1
                    cuts = [0, *range(4 * first, len(ids), 4 * size), len(ids)]
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                    yield pid, i, n, first, seen[first], whole, crcs, ids if keep_ids else None
                    seen[first] += 1
                    whole += len(crcs) - (first < size)

        yield from pack_rows(rows(), [x.split()[0] for x in TOKENISED.split(", ")], 1024, heavy=7)

    return run


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _placed(plan: Plan, size: int, keep_ids: bool):
    def run(batches):
        def rows():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("pid", "id", "n", "first", "rank", "base", "full", "crcs", "ids")]
                for pid, i, _, first, rank, base, full, crcs, ids in zip(*columns, strict=True):
                    start = 0
                    for k, crc in enumerate(crcs):
                        length = size if k else first
                        if length < size:
                            where, offset = plan.place(length, base + rank)
                        else:
                            where, offset = -1 - ((pid << 36) + full), 0
                            full += 1
                        yield i, k, start, length, crc, where, offset, *([ids[4 * start : 4 * (start + length)]] if keep_ids else [])
                        start += length

        yield from pack_rows(rows(), [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * keep_ids, heavy=7 if keep_ids else None)

    return run


def pack(docs: DataFrame, cap: Capacities = Capacities(), vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also ids.

    A document is its ids and id 2, so a null or empty text has one token. One longer than a sequence is cut into
    whole pieces behind a first one that may be shorter. Whole pieces have sequences of their own (negative
    numbers). The others are counted by length; the driver packs these counts (at most as many as a sequence has
    tokens), and the rank of each piece among those of its length finds its place in the plan. Rows that repeat are
    packed each. An empty table gives no rows."""
    size = cap.tokens
    if (cap.demand(size) > cap.vector).any():
        raise ValueError("a whole piece passes a capacity")
    rows = written(map_rows(plain(docs)[0].select("id", "text"), _tokenise(size, vocabulary, keep_ids), TOKENISED), "tokenised")
    parts = rows.filter(F.col("first") < size).groupBy("pid", "first").agg(F.count("*").alias("m"))
    counts = {r["first"]: r["m"] for r in parts.groupBy("first").agg(F.sum("m").alias("m")).collect()}  # a row a length
    plan = best_fit(counts, cap)
    before = Window.partitionBy("first").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("pid", "first", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    placed = rows.join(bases, ["pid", "first"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    return map_rows(placed, _placed(plan, size, keep_ids), PIECE + ", ids binary" * keep_ids)
