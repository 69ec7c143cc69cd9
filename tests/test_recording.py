"""Framing of recordings made here."""

import random
import struct

import numpy as np
import pytest

from busframe.sources.recording import Options, Recording, RecordingSource


def record(us, rt=15, sa=11, n=3, transmit=False, ts=3):
    words = [192 << 5 | 15, 54 << 10 | 50 << 4 | us >> 16, us & 0xFFFF] if ts == 3 else [us >> 16, us & 0xFFFF]
    cmd, data, status = rt << 11 | transmit << 10 | sa << 5 | n % 32, [0x1000 + us % 97 + k for k in range(n)], rt << 11
    body = [*words, cmd, *([status, *data] if transmit else [*data, status])]
    return struct.pack(f"<{len(body) + 1}H", (len(body) + 1) << 8 | (4 if transmit else 2), *body)


def offsets(data, **options):
    r = Recording.of(data, Options(**options))
    return [2 * at for run in r.runs() for at in (run.at + np.cumsum([0, *run.counts[:-1]])).tolist()], r


def each(data, **options):
    return [(run.ts_words, run.epoch) for run in Recording.of(data, Options(**options)).runs() for _ in run.counts]


def test_plain_and_terminated():
    data = b"".join(record(k * 100, n=3 + k) for k in range(4))
    at, r = offsets(data)
    assert len(at) == 4 and at[0] == 0 and r.status["outcome"] == "OK"
    assert len(offsets(data + b"\0\0junk!")[0]) == 4
    assert each(data)[0] == (3, 0)


def test_standard_clock():
    data = b"".join(record(100000 + k, n=3 + k, ts=2) for k in range(6))
    assert each(data) == [(2, 0)] * 6


def test_header_and_recovery():
    head = b"\xff" * 20
    a, b = record(5) + record(9, n=4), record(12, n=5) + record(20)
    at, r = offsets(head + a + b"\xff" * 30 + b)
    assert at[0] == 20 and len(at) == 4 and r.status["losses"] == 1
    assert [e for _, e in each(head + a + b"\xff" * 30 + b)] == [0, 0, 1, 1]


@pytest.mark.parametrize(("data", "outcome"), [(b"\0\0", "EMPTY_RECORDING"), (b"\xff" * 1024, "NO_RECORDS"), (b"\x20" * 1024, "HOMOGENEOUS"), (record(3)[:10], "FIRST_TRUNCATED"), (record(3) + record(9, n=4)[:12], "TRUNCATED_TAIL")])
def test_outcomes(data, outcome):
    assert offsets(data)[1].status["outcome"] == outcome


def test_random_bytes_end():
    rng = random.Random(256)
    for _ in range(128):
        offsets(rng.randbytes(rng.randint(32, 4096)))


def test_source(spark, tmp_path):
    paths = []
    for k in range(2):
        p = tmp_path / f"r{k}.bin"
        p.write_bytes(b"".join(record(100 * j + k, n=2 + j) for j in range(5)))
        paths.append(str(p))
    spark.dataSource.register(RecordingSource)
    rows = spark.read.format("busrec").option("paths", "\n".join(paths)).load().filter("status is null").orderBy("file_idx", "seq").collect()
    assert [(r["file_idx"], r["seq"]) for r in rows] == [(f, s) for f in range(2) for s in range(5)]
    assert all(len(r["w"]) == r["nwords"] and r["ts_format"] == "IRIG" for r in rows)
