"""The command line from bytes to files, texts and exit codes, on recordings made here."""

import io
import tracemalloc

import pytest
from test_plans import ERRORED, RT_TO_RT, SPURIOUS, cells, saved, words
from test_recording import record

from busframe import config as C
from busframe import errors as E
from busframe.__main__ import main
from busframe.functions import words as W
from busframe.plans import decode as P
from busframe.sources.recording import Options, Recording, RecordingSource, _File, _Reader

GOOD = record(100) + record(200, n=4) + record(300, n=5)
#: A transmission whose command receives: a structural rule is broken.
WRONG = words(350, 4, 15 << 11 | 3, 0x7800, 1, 2, 3)
ODD_CODE = words(360, 2, 15 << 11 | 11 << 5 | 3, 7, 0x0999, bit=1 << 14)
#: So much of nothing that the scan for the next record gives up.
GAP = b"\xff" * 70_000
STANDARD = b"".join(record(100000 + 16 * k, n=3 + k, ts=2) for k in range(6))


@pytest.mark.parametrize(("data", "args", "code", "rows"), [
    (GOOD, [], 0, 3), (GOOD, ["--strict"], 0, 3), (b"", [], 1, None), (b"\xff" * 1024, [], 2, None), (b"\x20" * 1024, [], 2, None), (b"\0\0" * 8, [], 0, 0),
    (GOOD + WRONG, [], 0, 3), (GOOD + WRONG, ["--strict"], 1, None), (GOOD + ODD_CODE, [], 0, 4), (GOOD + ODD_CODE, ["--strict"], 1, None),
    (GOOD + b"\xff" * 30 + GOOD, [], 0, 6), (GOOD + b"\xff" * 30 + GOOD, ["--strict"], 1, None), (record(3)[:10], [], 0, 0), (record(3)[:10], ["--strict"], 1, None),
    (GOOD + GAP, [], 3, None), (GOOD, ["--time-format", "standard", "--strict"], 2, None), (STANDARD, ["--time-format", "STANDARD", "--strict"], 0, 6),
    (GOOD + ERRORED + SPURIOUS + RT_TO_RT, ["--exclude-types", "spurious_data,0x08", "--exclude-rts", "0x3"], 0, 4), (GOOD + ERRORED + RT_TO_RT, ["--include-types", "RT_TO_RT"], 0, 1),
])
def test_ends(spark, tmp_path, data, args, code, rows):
    out = tmp_path / "out.csv"
    assert main(["decode", *saved(tmp_path, data), "-o", str(out), *args]) == code
    assert out.exists() == (rows is not None) and (rows is None or len(cells(out)) == rows)


def test_partial(spark, tmp_path, capfd):
    """What came before a loss is kept apart; a file of a merge that gives nothing is left out."""
    lost, = saved(tmp_path, GOOD + GAP)
    out = tmp_path / "out.csv"
    out.write_text("old")
    assert main(["decode", lost, "-o", str(out), "--allow-partial"]) == 0
    assert out.read_text() == "old" and len(cells(f"{out}.partial")) == 3
    assert main(["decode", lost]) == 3 and len(capfd.readouterr().out.splitlines()) == 4
    assert main(["count", lost]) == 1
    (tmp_path / "m").mkdir()
    paths = [*saved(tmp_path / "m", GOOD, record(150) + record(250, n=4) + GAP, b"\xff" * 1024), str(tmp_path / "none.rec")]
    both = tmp_path / "both.csv"
    for some, code in ((paths[:2], 3), (paths[::2], 2), (paths[::3], 1)):
        assert main(["decode", *some, "-o", str(both)]) == code and not both.exists()
    assert main(["decode", *paths, "-o", str(both), "--allow-partial"]) == 0
    assert [r["TIME_STAMP"][-6:] for r in cells(f"{both}.partial")] == ["000100", "000150", "000200", "000250", "000300"] and not both.exists()


def test_merges(spark, tmp_path, capfd):
    free = bytearray(record(100))
    free[3] |= 0x80
    paths, out = saved(tmp_path, record(300) + record(100, n=4), record(200), bytes(free) + record(200)), str(tmp_path / "out.csv")
    assert main(["decode", *paths[:2], "-o", out]) == 0 and [r["TIME_STAMP"][-6:] for r in cells(out)] == ["000200", "000300", "000100"]
    assert "day.1553.x.y.m0.rec: not internally time-sorted 1 times" in capfd.readouterr().err
    assert main(["decode", *paths[:2], "-o", out, "--strict"]) == 1 and "is not internally time-sorted" in capfd.readouterr().err
    assert main(["decode", *paths[1:], "-o", out]) == 6
    assert main(["decode", *paths[:2], "-o", paths[1]]) == 1


@pytest.mark.parametrize("args", [["--exclude-types", "0x100"], ["--exclude-rts", "256"], ["--exclude-buses", "C"], ["--detect-records", "33"], ["--standard-tick-rate-hz", "0"], ["--collapse-window-us", "-1"], ["--odd"], ["--glob", "*"], ["--mux-field", "x"], ["--delta-scope", "all"]])
def test_usage(tmp_path, args):
    assert main(["decode", *saved(tmp_path, GOOD), *args]) == 4


@pytest.mark.parametrize("text", [
    "[decode]\nstrict = 1", "[decode]\ntime_format = 'irig'", "[decode]\ntime_format = 3", "[decode]\nstrict = true\nstrict = true", "[decode]\n[decode]", "[a.b]", "[[decode]]", "decode.strict = true", "decode = 1", "[output]\nmax_sort_group = 0x10",
    "[output]\nmax_sort_group = 1_000", "[filter]\nexclude_rts = [32]", "[filter]\nexclude_types = ['x']", '[filter]\nexclude_types = ["x"]', "[filter]\nexclude_rts = 3", "[filter]\nexclude_rts = [\n1]", "[mux]\ndelimiter = \"\"", "[logging]\nlevel = \"loud\"", "[output]\nformat = \"xml\"", "x = {a = 1}", "[merge]\ncollapse_window_us = -1", "nothing",
])
def test_bad_configurations(tmp_path, text):
    path = tmp_path / "c.toml"
    path.write_text(text)
    with pytest.raises(E.BadConfiguration):
        C.load(str(path))
    assert main(["--config", str(path), "decode", "x"]) == 5
    assert main(["decode", "x", "--config", str(tmp_path)]) == 5


def test_configuration(spark, tmp_path, capfd):
    path = tmp_path / "c.toml"
    path.write_text('odd = 1\n[decode] # where\nstrict = true\ntime_format = "IRIG"\nother = "#"\n[filter]\nexclude_types = ["rt_to_rt", 0x04]\n'.replace("0x04", "4") + 'exclude_buses = ["b"]\n[mux]\nenabled = false\n[logging]\nlevel = "off"')
    found, unknown = C.load(str(path))
    assert found == {"strict": True, "time_format": "irig", "exclude": {"msg_type": [8, 4], "bus": [1]}, "mux_enabled": False, "log_level": "OFF"} and unknown == ["[] odd", "[decode] other"]
    out = str(tmp_path / "out.csv")
    assert main(["--config", str(path), "decode", *saved(tmp_path, GOOD + RT_TO_RT), "-o", out, "--exclude-subaddresses", "1,2"]) == 0
    assert [(r["MSG"], r["MUX"]) for r in cells(out)] == [("11R", "")] * 3 and not capfd.readouterr().err
    assert main(["--config", str(path), "count", *saved(tmp_path, GOOD + RT_TO_RT)]) == 0 and capfd.readouterr().out == "3\n"


def test_reports(spark, tmp_path, capfd):
    path, = saved(tmp_path, ERRORED + SPURIOUS + record(3)[:16])
    capfd.readouterr()
    assert main(["dump", path]) == 0
    told = capfd.readouterr()
    lines = told.out.splitlines()
    assert f"truncated record at 0x{len(ERRORED + SPURIOUS):08X}" in told.err
    assert lines[:5] == [f"File: day.1553.x.y.m0.rec ({len(ERRORED + SPURIOUS) + 16} bytes)", "Record dump starting at offset 0x00000000", "", "-" * 72, f"  Record #0  @  0x00000000  ({len(ERRORED)} bytes, {len(ERRORED) // 2} words)"]
    assert lines[5:10] == ["  Type:   0x4802  ->  BC->RT (Receive)  Bus A  error flag (bit 14): SET", "  Format: RECEIVE", "  Time:   192:15:54:50.000300", "  Cmd:    0x7963  ->  RT15 SA11 R WC=3", "  Error:  0x011E  ->  Manchester/Parity Error or Bit Count Error"]
    assert lines[10] == "  " + raw_lines(ERRORED, 0)[0]
    assert lines[-2:] == ["-" * 72, "2 records dumped."] and lines[-3].startswith(f"  !! Truncated record at 0x{len(ERRORED + SPURIOUS):08X} (18 bytes needed, 16 available)")
    assert main(["dump", path, "--records", "1"]) == 0 and capfd.readouterr().out.endswith("1 records dumped.\n")
    assert main(["dump", path, "--raw", "--offset", "4", "--length", "0x14"]) == 0
    assert capfd.readouterr().out.splitlines()[1:] == ["Range: 0x00000004-0x00000018", "", *raw_lines((ERRORED + SPURIOUS)[4:24], 4)]
    assert main(["dump", path, "--raw", "--offset", "100000"]) == 0 and len(capfd.readouterr().out.splitlines()) == 3
    assert main(["dump", str(tmp_path / "none")]) == 1 and main(["dump", path, "--offset", "-1"]) == 4


def raw_lines(data, at):
    out = []
    for k in range(0, len(data), 16):
        own = data[k : k + 16]
        out.append(f"  {at + k:08X}  {' '.join(f'{b:02X}' for b in own):<48}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in own)}|")
    return out


def test_tally_and_events(spark, tmp_path):
    path, = saved(tmp_path, GOOD + WRONG + ODD_CODE + b"\xff" * 30 + GOOD)
    with P.decode(spark, [path], P.Settings(exclude={"rt": [3]})) as found:
        assert found.tally() == {"accepted": 7, "rejected": 1, "collapsed": 0, "excluded": 0, "out": 7, "sync_losses": 1} and found.ended == "partial-recovered"
        told = {r["event"]: r["n"] for r in P.diagnostics(found).collect()}
    assert told == {"CLOCK_DAY": 1, "DIRECTION_NOT_TRANSMIT": 1, "UNKNOWN_ERROR_CODE": 1, "SYNC_LOSS": 1, "KEY_BACKWARD": 1}


def test_clock_probe():
    status = lambda data, **o: (r := Recording.of(data, Options(**o)), list(r.runs()))[0].status
    assert status(GOOD)["confidence"] == "DECISIVE" and status(GOOD)["clock"] == "OK"
    assert status(GOOD, time_format="standard")["clock"] == "CONFLICT"
    assert status(GOOD, time_format="standard", strict=True)["outcome"] == "STRICT_CLOCK"
    strict = status(GOOD + b"\xff" * 30 + GOOD, strict=True)
    assert [strict[k] for k in ("outcome", "offset", "losses", "raw", "have")] == ["STRICT_UNKNOWN_TYPE", len(GOOD), 1, 0xFFFF, 30 + len(GOOD)]


def test_odd_sizes_and_blocks(monkeypatch):
    """Chains that cross blocks, and odd last bytes, give the records of a plain walk."""
    from busframe.sources import recording

    monkeypatch.setattr(recording, "LEAST_BLOCK", 64)
    monkeypatch.setattr(recording, "BLOCK", 128)
    data = b"".join(record(k, n=1 + k % 30) for k in range(500))
    for end in (b"", b"\1", b"\2\x20\3", record(3)[:9]):
        own = Recording.of(data + end)
        counts = [int(n) for run in own.runs() for n in run.counts]
        assert counts == [7 + k % 30 for k in range(500)] and own.status["outcome"] == ("OK" if len(end) < 8 else "TRUNCATED_TAIL")


def test_memory_stays_flat(tmp_path):
    """Reading six times the records takes little more memory."""
    from pyspark.sql.types import StructType

    peaks = []
    for n in (100_000, 600_000):
        path = tmp_path / f"{n}.rec"
        path.write_bytes(b"".join(record(k % 900_000, n=1 + k % 3) for k in range(1000)) * (n // 1000))
        reader = _Reader([str(path)], Options(), StructType.fromDDL(RecordingSource({}).schema()), None, None)
        tracemalloc.start()
        rows = sum(b.num_rows for b in reader.read(_File(0, str(path))))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n + 1
    assert peaks[1] < 1.5 * peaks[0]


def test_closed_reader(monkeypatch):
    from busframe import __main__ as M

    class Closed(io.StringIO):
        def write(self, _):
            raise BrokenPipeError

        def fileno(self):
            return M.os.dup(2)

    monkeypatch.setattr(M.sys, "stdout", Closed())
    M.printed(iter(["a"]))


def test_titles_and_vendor_clock(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        W.titled(F.lit(0x0140), W.ERROR_TITLES, F.lit("none")), W.titled(F.lit(5), W.ERROR_TITLES, F.lit("none")), W.known_code(F.lit(0x2001)), W.known_error(F.lit(0x2001)), W.vendor_us(F.lit(" 1:02:03:04.5 ")), W.vendor_us(F.lit("0x00FF")), W.vendor_us(F.lit("1:2:3")),
        W.vendor_us(F.lit("0:0:0:1.12345678")), W.mux(F.lit("a.\t b .c"), ".", 1)).first()
    assert tuple(row) == ("Too Many Data Words", "none", True, False, (26 * 3600 + 3 * 60 + 4) * 10**6 + 500_000, None, None, 1_123_456, "b")


def test_sinks_that_come_short(spark, tmp_path, monkeypatch):
    """If not all parts reach the driver, nothing is written."""
    from busframe.sinks import csv

    paths, out = saved(tmp_path, GOOD), tmp_path / "out.csv"
    monkeypatch.setattr(csv, "HEADER", csv.HEADER + "\n")  # the sizes no longer agree
    size = csv.os.path.getsize
    monkeypatch.setattr(csv.os.path, "getsize", lambda p: size(p) - (5 if ".csv." in str(p) else 0))
    with pytest.raises(E.WriteFailed):
        P.to_csv(spark, paths, str(out))
    assert list(tmp_path.glob("out*")) == []
