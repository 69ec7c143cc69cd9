"""python -m busframe [--config FILE] [--log-level LEVEL] decode|count|dump ..."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import re
import sys
from collections.abc import Iterator

from busframe import __version__
from busframe import config as C
from busframe.errors import BadConfiguration, BadUsage, BusframeError
from busframe.sources.inputs import resolve

AXES = {"types": ("msg_type", C.message_type), "rts": ("rt", None), "buses": ("bus", C.bus), "subaddresses": ("sa", None)}
log = logging.getLogger("busframe")
#: How log lines name these events; others go by their own names.
TOLD = {"EMPTY_RECORDING": "empty recording (empty capture)", "KEY_BACKWARD": "non-monotonic timestamp of a key", "FILE_BACKWARD": "not internally time-sorted", "SYNC_LOSS": "sync loss, scanning forward"}


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise BadUsage(f"{self.prog}: {message}")


class Listed(argparse.Action):
    """Values between commas; a flag that comes again adds to them."""

    def __call__(self, parser, namespace, values, option_string=None):
        held = getattr(namespace, self.dest, None) or []
        setattr(namespace, self.dest, held + [x.strip() for x in values.split(",") if x.strip()])


def size(text: str) -> int:
    """A number of 0 or more, also as 0x, 0o or 0b."""
    try:
        n = int(text, 0)
    except ValueError:
        n = -1
    if n < 0:
        raise argparse.ArgumentTypeError(f"{text!r} is no number of 0 or more")
    return n


def octet(text: str) -> int:
    """An address of a filter: 0 to 255, decimal or 0x. That no bus has more than 31 only the configuration checks."""
    if not re.fullmatch(r"0[xX][0-9a-fA-F]+|[0-9]+", text) or (n := int(text, 16 if text[:2].lower() == "0x" else 10)) > 255:
        raise ValueError(f"{text!r} is no number from 0 to 255")
    return n


def parser() -> argparse.ArgumentParser:
    top = Parser(prog="busframe", description="Decodes recordings of MIL-STD-1553 bus monitors.")
    top.add_argument("-v", "-V", "--version", action="version", version=f"%(prog)s {__version__}")
    shared = argparse.ArgumentParser(add_help=False)
    for p, default in ((top, None), (shared, argparse.SUPPRESS)):
        p.add_argument("--config", metavar="FILE", default=default)
        p.add_argument("--log-level", metavar="LEVEL", default=default)
    subs = top.add_subparsers(dest="command", required=True, parser_class=Parser)
    p = subs.add_parser("decode", parents=[shared], help="write a recording's messages, or those of several merged, as CSV")
    p.add_argument("inputs", nargs="*")
    p.add_argument("-o", "--output")
    for flag in ("--manifest", "--glob", "--time-format", "--format", "--mux-delimiter", "--delta-scope"):
        p.add_argument(flag)
    for flag in ("--detect-records", "--lookahead-records", "--max-sort-group", "--mux-field", "--collapse-window-us"):
        p.add_argument(flag, type=int)
    p.add_argument("--standard-tick-rate-hz", type=float)
    for flag in ("--separate-errors", "--no-clobber", "--no-mux", "--collapse-duplicates", "--strict", "--allow-partial"):
        p.add_argument(flag, action="store_true", default=None)
    for way in ("exclude", "include"):
        for axis in AXES:
            p.add_argument(f"--{way}-{axis}", action=Listed, metavar="A,B")
    p = subs.add_parser("count", parents=[shared], help="print how many messages a recording has")
    p.add_argument("input")
    p = subs.add_parser("dump", parents=[shared], help="print a recording's bytes, by records or raw")
    p.add_argument("input")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--offset", type=size, default=0)
    p.add_argument("--length", type=size)
    p.add_argument("--records", type=size)
    return top


def settings(a: argparse.Namespace, from_file: dict) -> C.Settings:
    """The command line comes before the file, and the file before the defaults; excluded values add up."""
    out = dict(from_file)
    names = {f.name for f in dataclasses.fields(C.Settings)} - {"exclude", "include", "log_level"}
    given = {k: v for k, v in vars(a).items() if k in names and v is not None}
    if getattr(a, "separate_errors", None):
        given["error_mode"] = "separate"
    if getattr(a, "no_mux", None):
        given["mux_enabled"] = False
    kind = given.pop("format", "csv")
    lists: dict = {"exclude": {k: list(v) for k, v in out.pop("exclude", {}).items()}, "include": {}}
    try:
        for way, held in lists.items():
            for axis, (column, check) in AXES.items():
                if values := getattr(a, f"{way}_{axis}", None):
                    held[column] = held.get(column, []) + [(check or octet)(v) for v in values]
        s = C.Settings(**{**out, **given}, **lists)
    except ValueError as e:
        raise BadUsage(str(e)) from None
    if kind != "csv":
        raise BusframeError(f"there is no output format {kind}, only csv")
    return s


def told(level: str) -> None:
    """Log lines of a level and above go to standard error; OFF and CRITICAL leave none."""
    logging.basicConfig(stream=sys.stderr, format="%(levelname)s %(message)s", force=True)
    name = {"WARN": "WARNING", "OFF": "CRITICAL"}.get(level, level)
    log.setLevel(logging.CRITICAL + 1 if name == "CRITICAL" else name)


def printed(lines: Iterator[str]) -> None:
    """Lines to standard output. That nobody reads on is no error."""
    try:
        for line in lines:
            sys.stdout.write(line + "\n")
        sys.stdout.flush()
    except BrokenPipeError:
        log.info("the reader of the output closed it")
        # What is still in the buffer has nowhere to go.
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())


def tell(found) -> None:
    """What the messages and files of a decoding are worth a warning for, and its sums."""
    from busframe.plans.decode import diagnostics

    for f in found.statuses:
        if f["confidence"]:
            log.info("%s: clock %s (%s: IRIG=%s STD=%s over %s records)", f["path"], f["clock"], f["confidence"].capitalize(), f["irig"], f["standard"], f["probed"])
    for e in found.dropped:
        log.warning("could not be read; truncating it from the merge: %s", e)
    if log.isEnabledFor(logging.WARNING):
        for r in diagnostics(found).orderBy("file_idx", "event").collect():  # a row a file and kind of event
            log.warning("%s: %s %d times%s", r["path"], TOLD.get(r["event"], r["event"].lower().replace("_", " ")), r["n"], "" if r["first_offset"] is None else f", first at 0x{r['first_offset']:X}")
    if log.isEnabledFor(logging.INFO):
        log.info("%s", ", ".join(f"{k} {v}" for k, v in found.tally().items()))


def decode(spark, a: argparse.Namespace, s: C.Settings) -> None:
    from busframe.operators.messages import rows46
    from busframe.plans.decode import ORDER, decode
    from busframe.sinks import csv

    paths = resolve(a.inputs, a.manifest, a.glob)
    apart = s.error_mode == "separate" and a.output is not None
    if s.error_mode == "separate" and a.output is None:
        log.warning("errors can't go apart on standard output")
    if a.output is not None:
        csv.preflight(a.output, paths, s.no_clobber, apart)
    with decode(spark, paths, s) as found:
        tell(found)
        rows = rows46(found.rows, ORDER)
        if a.output is None:
            printed(csv.lines(rows, ORDER))
        if found.lost and not s.allow_partial:
            raise found.lost
        if a.output is not None:
            made = csv.write(rows, ORDER, a.output, apart, bool(found.lost or found.dropped))
            log.info("wrote %s", ", ".join(made))
        log.info("decode exit class: %s (sync losses %d)", found.ended, found.sync_losses)


def count(spark, path: str, s: C.Settings) -> None:
    from busframe.errors import SyncLost
    from busframe.plans.decode import count

    try:
        n = count(spark, path, s)
    except SyncLost as e:
        # Here a loss in the middle is an error like any other.
        raise BusframeError(str(e), **e.facts) from e
    if not n:
        log.warning("%s: empty recording, or none of its messages passes the filters", path)
    print(n)
    print(f"counted {n} messages in {os.path.basename(path)}", file=sys.stderr)


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("busframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        level = a.log_level.upper() if a.log_level else None
        if level not in (None, *C.LEVELS):
            raise BadUsage(f"--log-level must be one of {', '.join(C.LEVELS)}")
        told(level or "WARNING")
        from_file, unknown = C.load(a.config) if a.command != "dump" else ({}, [])
        told(level or from_file.get("log_level", "WARNING"))
        for key in unknown:
            log.warning("unknown setting: %s", key)
        if a.command == "dump":
            from busframe.plans import dump

            printed(dump.raw(session(), a.input, a.offset, a.length) if a.raw else dump.records(session(), a.input, a.offset, a.records))
        elif a.command == "count":
            count(session(), a.input, settings(a, from_file))
        else:
            s = settings(a, from_file)
            decode(session(), a, s)
        return 0
    except (BusframeError, OSError) as e:
        kind = "Config error" if isinstance(e, BadConfiguration) else "Error"
        print(f"{kind}: {e}", file=sys.stderr)
        return getattr(e, "exit_code", 1)


if __name__ == "__main__":
    sys.exit(main())
