"""Column and stream operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from busframe.functions import words as W
from busframe.operators import classify as C
from busframe.operators import streams as S


def stream(rng, n=300, files=3, back=True):
    out = []
    for f in range(files):
        us = 0
        for seq in range(n // files):
            us = max(0, us + rng.choice([0, 0, 1, 5] + [-3] * back))
            out.append((f, seq, us, rng.choice([3, 5, None, 21]), rng.randint(0, 2), rng.randint(0, 1)))
    return out


SCHEMA = "file_idx int, seq long, us long, rt int, sa int, dir int"


def test_all_words(spark):
    df = spark.range(65536).select(F.col("id").cast("int").alias("w"))
    tw = df.select("w", *[c.alias(k) for k, c in W.type_word(F.col("w")).items()]).collect()
    cw = df.select("w", *[c.alias(k) for k, c in W.command_word(F.col("w")).items()]).collect()
    for r, c in zip(tw, cw, strict=True):
        w = r["w"]
        assert tuple(r)[1:] == (w % 128, w // 128 % 2, w // 256 % 64, w // 16384 % 2 == 1, w >= 32768)
        assert tuple(c)[1:] == (w // 2048, w // 1024 % 2, w // 32 % 32, w % 32 or 32, w // 2048 == 31, w // 32 % 32 in (0, 31))


@pytest.mark.parametrize(("ticks", "hz", "us"), [(100000, 1e6, 100000), (1, 1e7, 0), (5, 1e7, 1), (15, 1e7, 2), (1, 1e-300, None), (1, None, None), (1, 0.0, None), (1, float("nan"), None), (2**32 - 1, 0.001, 4294967295000000000)])
def test_ticks(spark, ticks, hz, us):
    df = spark.createDataFrame([(ticks, hz)], "t long, hz double")
    got = df.select(W.ticks_to_us(F.col("t"), F.col("hz")).alias("us")).first()[0]
    assert (got if got is None else int(got)) == us


def test_texts(spark):
    row = spark.range(1).select(W.standard_text(F.lit(100000)), W.delta_text(F.lit(1250000).cast("long")), W.delta_text(F.lit(None).cast("long")), W.message_label(F.lit(11), F.lit(0)), W.mux(F.lit("a.b.c.d. x .e")), W.mux(F.lit("a.b"), ".", -1), W.mux(F.lit("a.b"), ".", 7)).first()
    assert tuple(row) == ("0x000186A0", "1.250000", "", "11R", "x", "b", None)


@pytest.mark.parametrize(("fmt", "n", "words", "status", "data"), [
    ("RECEIVE", 2, [1, 2, 9], 9, [1, 2]), ("TRANSMIT", 2, [9, 1, 2], 9, [1, 2]), ("RT_TO_RT", 3, [7, 9, 1, 2, 3, 8], 9, [1, 2, 3]), ("RECEIVE_BROADCAST", 2, [1, 2], None, [1, 2]),
    ("MODE_CODE_RX_DATA", 1, [5, 9], 9, [5]), ("MODE_CODE_NO_DATA", 1, [9], 9, []), ("MODE_CODE_BCAST_NO_DATA", 1, [], None, []), ("RECEIVE", 4, [1, 2], None, []),
])
def test_payload(spark, fmt, n, words, status, data):
    df = spark.createDataFrame([(fmt, n, [0, 0, 0, 0, 0, *words])], "fmt string, n int, w array<int>")
    out = C.payload(F.col("fmt"), F.col("w"), F.lit(5), F.col("n"))
    assert tuple(df.select(*[c.alias(k) for k, c in out.items()]).first()) == (status, data)


def test_delta(spark):
    rows = stream(random.Random(1))
    last, want = {}, {}
    for f, seq, us, *key in rows:
        k = (f, *key)
        want[f, seq] = 0 if k not in last else us - last[k] if us >= last[k] else None
        last[k] = us
    got = S.delta_per_file(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["file_idx"], r["seq"]): r["delta_us"] for r in got} == want


def test_merge_is_a_heap_merge(spark):
    import heapq

    rows = stream(random.Random(2))
    files = {f: [r for r in rows if r[0] == f] for f in range(3)}
    heap, want = [(files[f][0][2], f, 0) for f in files], []
    heapq.heapify(heap)
    while heap:
        _, f, k = heapq.heappop(heap)
        want.append((f, k))
        if k + 1 < len(files[f]):
            heapq.heappush(heap, (files[f][k + 1][2], f, k + 1))
    got = S.merge_key(spark.createDataFrame(rows, SCHEMA)).orderBy("run_max", "file_idx", "seq").collect()
    assert [(r["file_idx"], r["seq"]) for r in got] == want


@pytest.mark.parametrize("cap", [1, 4, 4096])
def test_canonical_order(spark, cap):
    rows = [(k, *r[2:]) for k, r in enumerate(sorted(stream(random.Random(3), back=False), key=lambda r: r[2]))]
    want, held = [], []

    def flush(full):
        groups, lead = [], []
        for r in held:
            if r[2] is None and not groups:
                lead.append(r)
            elif r[2] is None:
                groups[-1].append(r)
            else:
                groups.append([r])
        want.extend(held if full else lead + [x for g in sorted(groups, key=lambda g: g[0][2:]) for x in g])
        held.clear()

    for r in rows:
        if held and held[0][1] != r[1]:
            flush(False)
        held.append(r)
        if len(held) == cap:
            flush(True)
    flush(False)
    df = spark.createDataFrame(rows, "pos long, us long, rt int, sa int, dir int")
    got = S.canonical_order(df, cap).orderBy("us", "chunk", "place").collect()
    assert [r["pos"] for r in got] == [r[0] for r in want]


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, None, 2), (2, 5, None)], "seq long, rt int, sa int")
    seqs = lambda x: {r["seq"] for r in x.collect()}
    assert seqs(S.keep_messages(df, {"rt": [1], "sa": [9]})) == {1, 2}
    assert seqs(S.keep_messages(df, None, {"rt": [1, 5], "sa": [2]})) == {0}
    assert seqs(S.keep_messages(df, {"rt": [1]}, {"rt": [1, 5]})) == {2}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
