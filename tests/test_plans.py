"""Decoding from bytes to files, and the operators that only loops can be held against."""

import random
import struct
from collections import deque

import pytest
from pyspark.sql import functions as F
from test_recording import record
from test_streams import SCHEMA, stream

from busframe.__main__ import main
from busframe.operators import streams as S
from busframe.plans import decode as P
from busframe.sources.inputs import matching, resolve


def words(us, kind, *body, bit=0):
    head = [192 << 5 | 15, 54 << 10 | 50 << 4 | us >> 16, us & 0xFFFF]
    return struct.pack(f"<{len(body) + 4}H", (len(body) + 4) << 8 | kind | bit, *head, *body)


ERRORED = words(300, 2, 15 << 11 | 11 << 5 | 3, 7, 8, 0x011E, bit=1 << 14)
SPURIOUS = words(400, 0x20, 0xBEEF)
RT_TO_RT = words(500, 8, 15 << 11 | 1 << 10 | 22 << 5 | 3, 5 << 11 | 4 << 5 | 3, 0x7800, 1, 2, 3, 0x2800)


def saved(tmp_path, *files):
    out = []
    for k, data in enumerate(files):
        p = tmp_path / f"day.1553.x.y.m{k}.rec"
        p.write_bytes(data)
        out.append(str(p))
    return out


def cells(path):
    with open(path) as f:
        head, *rows = [x.rstrip("\n").split(",") for x in f]
    return [dict(zip(head, r, strict=True)) for r in rows]


def test_decode_to_csv(spark, tmp_path):
    paths = saved(tmp_path, record(100) + record(200) + ERRORED + SPURIOUS + RT_TO_RT + words(600, 4, 15 << 11 | 3, 0x7800, 1, 2, 3))
    out = str(tmp_path / "out.csv")
    assert P.to_csv(spark, paths, out) == [out]
    rows = cells(out)
    assert len(rows[0]) == 46 and len(rows) == 5  # the transmission with a receive command is rejected
    assert [r["TIME_STAMP"] for r in rows] == [f"192:15:54:50.000{k}00" for k in range(1, 6)]
    assert [r["MSG"] for r in rows] == ["11R", "11R", "11R", "", "22T"]
    assert [r["DELTA"] for r in rows] == ["0.000000", "0.000100", "0.000100", "", "0.000000"]
    assert [(r["ERROR"], r["ERROR_CODE"]) for r in rows] == [("", ""), ("", ""), ("ERROR", "011E"), ("SPURIOUS", "2000"), ("", "")]
    assert [rows[4][c] for c in ("WD01", "WD02", "WD03", "WD04", "STAT", "CMD", "MUX", "BUS")] == ["0001", "0002", "0003", "", "7800", "7EC3", "m0", "A"]
    assert (rows[2]["WD01"], rows[2]["WD02"], rows[2]["WD03"], rows[2]["STAT"]) == ("0007", "0008", "", "")
    assert rows[3]["WD01"] == "BEEF" and rows[3]["RT"] == ""


def test_errors_apart(spark, tmp_path):
    paths, out = saved(tmp_path, record(100) + ERRORED + SPURIOUS), str(tmp_path / "out.csv")
    made = P.to_csv(spark, paths, out, P.Settings(error_mode="separate"))
    assert [len(cells(x)) for x in made] == [1, 2] and made[1].endswith("out_errors.csv")
    with pytest.raises(FileExistsError):
        P.to_csv(spark, paths, out, P.Settings(no_clobber=True))
    with pytest.raises(ValueError):
        P.to_csv(spark, paths, paths[0])
    clean = saved(tmp_path, record(100))
    assert len(P.to_csv(spark, clean, str(tmp_path / "b.csv"), P.Settings(error_mode="separate"))) == 1


def test_merge(spark, tmp_path):
    paths, out = saved(tmp_path, record(100) + record(300), record(200) + record(300) + ERRORED.replace(b"\x2c\x01", b"\x90\x01")), str(tmp_path / "m.csv")
    P.to_csv(spark, paths, out)
    assert [(r["TIME_STAMP"][-6:], r["DELTA"], r["MUX"]) for r in cells(out)][:4] == [("000100", "0.000000", "m0"), ("000200", "0.000000", "m1"), ("000300", "0.000200", "m0"), ("000300", "0.000100", "m1")]
    P.to_csv(spark, paths, out, P.Settings(delta_scope="global", collapse_duplicates=True))
    assert [(r["TIME_STAMP"][-6:], r["DELTA"]) for r in cells(out)] == [("000100", "0.000000"), ("000200", "0.000100"), ("000300", "0.000100"), ("000400", "0.000100")]
    with pytest.raises(P.IncompatibleInputs):
        P.stream(spark, saved(tmp_path, record(100) + record(200), b"".join(record(1000 + k, n=3 + k, ts=2) for k in range(6))))


def test_standard_clock(spark, tmp_path):
    paths = saved(tmp_path, b"".join(record(100000 + 16 * k, n=3 + k, ts=2) for k in range(6)))
    out = str(tmp_path / "s.csv")
    P.to_csv(spark, paths, out)
    assert [(r["TIME_STAMP"], r["DELTA"]) for r in cells(out)][:2] == [("0x000186A0", ""), ("0x000186B0", "")]
    P.to_csv(spark, paths, out, P.Settings(standard_tick_rate_hz=1e6))
    assert [r["DELTA"] for r in cells(out)][:2] == ["0.000000", "0.000016"]


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("window", [0, 3])
def test_collapse_window(spark, back, window):
    rows = stream(random.Random(5), back=back)
    df = spark.createDataFrame(rows, SCHEMA)
    merged = [tuple(r)[:6] for r in S.merge_key(df).orderBy("run_max", "file_idx", "seq").collect()]
    kept, want = deque(), set()
    for r in merged:
        while kept and r[2] - kept[0][2] > window:
            kept.popleft()
        if not any(k[0] != r[0] and abs(k[2] - r[2]) <= window and k[3:] == r[3:] for k in kept):
            kept.append(r)
            want.add(r[:2])
    got = S.collapse_window(df, ["rt", "sa", "dir"], window).collect()
    assert {(r["file_idx"], r["seq"]) for r in got} == want and len(got) == len(want) < len(rows)


@pytest.mark.parametrize("cap", [1, 4, 4096])
def test_canonical_order_of_stepping_streams(spark, cap):
    rng = random.Random(8)
    rows = [(k, rng.randint(0, 1), rng.choice([3, 5, None, 21]), rng.randint(0, 2), rng.randint(0, 1)) for k in range(300)]
    want, held = [], []

    def flush(full):
        groups, lead = [], []
        for r in held:
            if r[2] is not None:
                groups.append([r])
            else:
                (groups[-1] if groups else lead).append(r)
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
    got = S.canonical_order_any(df, cap, 16).orderBy("run", "chunk", "place").collect()
    assert [r["pos"] for r in got] == [r[0] for r in want]


def test_inputs(tmp_path):
    for name in ("b1.rec", "a[1].rec", "a2.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [x.rpartition("/")[2] for x in matching(f"{tmp_path}/*.rec")] == ["a[1].rec", "b1.rec"]
    assert len(matching(f"{tmp_path}/a[1].rec")) == 1 and matching(f"{tmp_path}/?2.*")[0].endswith("a2.txt")
    (tmp_path / "list").write_text("# two\n\n  x \ny\n")
    assert resolve(manifest_path=str(tmp_path / "list")) == ["x", "y"]
    for bad in ({}, {"paths": ["a"], "pattern": "*"}, {"paths": ["a"] * 257}):
        with pytest.raises(ValueError):
            resolve(**bad)


def test_command_line(spark, tmp_path, capfd):
    paths, out = saved(tmp_path, record(100) + record(200, rt=3)), str(tmp_path / "c.csv")
    (tmp_path / "c.toml").write_text("[mux]\nfield = 0\n[filter]\nexclude_rts = [3]\n[decode]\nodd = 1\n")
    assert main(["decode", *paths, "--output", out, "--config", str(tmp_path / "c.toml")]) == 0
    assert [(r["RT"], r["MUX"]) for r in cells(out)] == [("15", "day")]
    assert main(["count", paths[0]]) == 0 and main(["dump", paths[0], "--raw", "--offset", "0x10", "--length", "17"]) == 0
    text = capfd.readouterr().out
    assert text.startswith("2\n") and "Range: 0x00000010-0x00000021" in text and "\n  00000020  " in text
    assert main(["decode", "--output", out]) == 4
    assert main(["decode", *saved(tmp_path, b"\xff" * 1024), "--output", out]) == 2


def test_settings():
    for bad in ({"detect_records": 33}, {"collapse_window_us": -1}, {"time_format": "x"}, {"standard_tick_rate_hz": 0.0}, {"mux_delimiter": ""}):
        with pytest.raises(ValueError):
            P.Settings(**bad)
