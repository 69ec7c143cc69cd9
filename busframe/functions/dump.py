"""Hex reports of bytes and records, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from busframe.functions import words as W
from busframe.operators.classify import message_format

RULE = "-" * 72


def window(data: Column, offset: int = 0, length: int | None = None) -> tuple[Column, Column]:
    """Start and end of a window, both within the data."""
    size = F.length(data)
    start = F.least(F.lit(offset), size)
    return start, F.greatest(start, size if length is None else F.least(F.lit(offset + length), size))


def chunks(data: Column, start: Column, end: Column) -> Column:
    """array<struct<at, part>>: 16 bytes each from start on; empty where there are none."""
    return F.when(end > start, F.transform(F.sequence(start, end - 1, F.lit(16)), lambda at: F.struct(at.cast("long").alias("at"), F.substring(data, at + 1, F.least(F.lit(16), end - at)).alias("part"))))


def _line(at: Column, pairs: Column, shown: Column, indent: int) -> Column:
    return F.concat(F.lit(" " * indent), F.lpad(F.hex(at), 8, "0"), F.lit("  "), F.rpad(pairs, 48, " "), F.lit("  |"), shown, F.lit("|"))


def hex_line(at: Column, part: Column, indent: int = 2) -> Column:
    """Offset, bytes padded to 48 characters, and the ASCII ones between bars."""
    shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    return _line(at, F.rtrim(F.regexp_replace(F.hex(part), "(..)", "$1 ")), shown, indent)


def words_lines(offset: Column, w: Column) -> Column:
    """Hex lines of a record's words, eight a line."""
    def line(k: Column) -> Column:
        own = F.slice(w, k * 8 + 1, F.lit(8))
        low, high = lambda x: x.bitwiseAND(255), lambda x: F.shiftright(x, 8)
        text = lambda b: F.when((b >= 32) & (b < 127), F.chr(b)).otherwise(F.lit("."))
        pairs = F.array_join(F.transform(own, lambda x: F.concat_ws(" ", F.lpad(F.hex(low(x)), 2, "0"), F.lpad(F.hex(high(x)), 2, "0"))), " ")
        shown = F.array_join(F.transform(own, lambda x: F.concat(text(low(x)), text(high(x)))), "")
        return _line(offset + k * 16, pairs, shown, 4)

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 8).cast("int")), line)


def record_block(seq: Column, offset: Column, w: Column) -> Column:
    """What a record's words say, as lines: type, format, absolute clock, command and, if it is errored, its last word."""
    t, tw, c = W.irig(F.get(w, 1), F.get(w, 2), F.get(w, 3)), W.type_word(F.get(w, 0)), W.command_word(F.get(w, 4))
    hex4 = lambda x: F.concat(F.lit("0x"), W.hex_text(x, 4))
    unknown = F.concat(F.lit("UNKNOWN(0x"), F.lpad(F.hex(tw["msg_type"]), 2, "0"), F.lit(")"))
    fmt = F.coalesce(message_format(tw["msg_type"], c["rt"], c["dir"], tw["word_count"], F.lit(3)), F.lit("(unclassifiable)"))
    last = F.get(w, F.size(w) - 1)
    text = lambda x: x.cast("string")
    return F.concat_ws(
        "\n", F.lit(RULE), F.concat(F.lit("  Record #"), text(seq), F.lit("  @  0x"), F.lpad(F.hex(offset), 8, "0"), F.lit("  ("), text(2 * F.size(w)), F.lit(" bytes, "), text(F.size(w)), F.lit(" words)")),
        F.concat(F.lit("  Type:   "), hex4(F.get(w, 0)), F.lit("  ->  "), W.titled(tw["msg_type"], W.TYPE_TITLES, unknown), F.when(tw["bus"] == 1, "  Bus B  ").otherwise("  Bus A  "), F.lit("error flag (bit 14): "), F.when(tw["is_err"], "SET").otherwise("clear")),
        F.concat(F.lit("  Format: "), fmt), F.concat(F.lit("  Time:   "), W.irig_text(t), F.when(t["freerun"], "  [FREERUN]").otherwise("")),
        F.concat(F.lit("  Cmd:    "), hex4(F.get(w, 4)), F.lit("  ->  RT"), text(c["rt"]), F.lit(" SA"), text(c["sa"]), F.when(c["dir"] == 1, " T").otherwise(" R"), F.lit(" WC="), text(c["n"])),
        F.when(tw["is_err"], F.concat(F.lit("  Error:  "), hex4(last), F.lit("  ->  "), W.titled(last, W.ERROR_TITLES, F.lit("unknown DDC error code")))),
        F.array_join(words_lines(offset, w), "\n"),
    )
