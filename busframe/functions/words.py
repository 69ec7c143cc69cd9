"""Bit-field decoding and text forms of bus words, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_TYPES = (0x01, 0x02, 0x04, 0x08, 0x10, 0x18, 0x20)
# What reports call the types and the error codes.
TYPE_TITLES = {0x01: "Mode Command", 0x02: "BC->RT (Receive)", 0x04: "RT->BC (Transmit)", 0x08: "RT->RT", 0x10: "Broadcast BC->RT", 0x18: "Broadcast RT->RT", 0x20: "Spurious Data"}
ERROR_TITLES = {0x011E: "Manchester/Parity Error or Bit Count Error", 0x0120: "No Status Response or Too Few Data Words", 0x0136: "Inverted Sync on Data Word", 0x0140: "Too Many Data Words", 0x0150: "Unknown DDC Error"}
#: Codes that are given to spurious records: behind an errored one, and alone.
SPURIOUS_CODES = (0x2000, 0x2001)


def bits(word: Column, low: int, width: int) -> Column:
    return F.shiftright(word, low).bitwiseAND((1 << width) - 1)


def type_word(w: Column) -> dict[str, Column]:
    return {"msg_type": bits(w, 0, 7), "bus": bits(w, 7, 1), "word_count": bits(w, 8, 6), "is_err": bits(w, 14, 1) == 1, "reserved": bits(w, 15, 1) == 1}


def command_word(w: Column) -> dict[str, Column]:
    n, rt, sa = bits(w, 0, 5), bits(w, 11, 5), bits(w, 5, 5)
    return {"rt": rt, "dir": bits(w, 10, 1), "sa": sa, "n": F.when(n == 0, 32).otherwise(n), "broadcast": rt == 31, "mode_code": sa.isin(0, 31)}


def irig(upper: Column, middle: Column, lower: Column) -> dict[str, Column]:
    return {"day": bits(upper, 5, 9), "hour": bits(upper, 0, 5), "minute": bits(middle, 10, 6), "second": bits(middle, 4, 6), "micros": F.shiftleft(bits(middle, 0, 4), 16).bitwiseOR(lower), "freerun": bits(upper, 15, 1) == 1}


def irig_us(t: dict[str, Column]) -> Column:
    """Microseconds of a clock that names no year; days aren't counted from zero."""
    return ((t["day"] * 86400 + t["hour"] * 3600 + t["minute"] * 60 + t["second"]).cast("long") * 1_000_000 + t["micros"]).cast("long")


def irig_text(t: dict[str, Column]) -> Column:
    return F.format_string("%d:%02d:%02d:%02d.%06d", t["day"], t["hour"], t["minute"], t["second"], t["micros"] % 1_000_000)


def hex_text(w: Column, digits: int) -> Column:
    return F.lpad(F.hex(w), digits, "0")


def standard_text(counter: Column) -> Column:
    return F.concat(F.lit("0x"), hex_text(counter, 8))


def ticks_to_us(ticks: Column, hz: Column) -> Column:
    """Microseconds of a counter, halves away from zero; null if the rate is unset, not positive or not finite, or 2^64 is passed."""
    x = ticks.cast("double") * F.lit(1e6) / F.when(hz > 0, hz)
    whole = F.when((x >= 0) & (x < F.lit(2.0**64)) & ~F.isnan(x), x)
    part = whole % 1
    return ((whole - part).cast("decimal(20,0)") + F.when(part >= 0.5, 1).otherwise(0)).cast("decimal(20,0)")


def message_label(sa: Column, direction: Column) -> Column:
    return F.concat(sa.cast("string"), F.when(direction == 1, "T").otherwise("R"))


def error_label(is_err: Column, fmt: Column) -> Column:
    return F.when(is_err, "ERROR").when(fmt == "SPURIOUS_DATA", "SPURIOUS").otherwise("")


def delta_text(delta_us: Column) -> Column:
    whole = F.floor(delta_us / 1_000_000).cast("long")
    return F.when(delta_us.isNull(), "").otherwise(F.format_string("%d.%06d", whole, (delta_us % 1_000_000).cast("long")))


def mux(name: Column, delimiter: str = ".", field: int = 4) -> Column:
    """A field of a file name, from 0 or from the end, trimmed; null if there is none."""
    part = F.split_part(name, F.lit(delimiter), F.lit(field + 1 if field >= 0 else field))
    return F.nullif(F.regexp_replace(part, r"(?U)^\s+|\s+$", ""), F.lit(""))


def known_error(code: Column) -> Column:
    return code.isin(*ERROR_TITLES)


def known_code(code: Column) -> Column:
    return code.isin(*ERROR_TITLES, *SPURIOUS_CODES)


def titled(value: Column, titles: dict[int, str], other: Column) -> Column:
    """The title of a value, or other."""
    pairs = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), other)


def vendor_us(text: Column) -> Column:
    """Microseconds of a clock text D:HH:MM:SS.uuuuuu, as irig_us has them; null if it isn't one. Of the decimals the
    first six count."""
    form = r"^\s*(\d+):(\d+):(\d+):(\d+)(?:\.(\d*))?\s*$"
    part = lambda k: F.regexp_extract(text, form, k)
    whole = ((part(1).cast("long") * 24 + part(2).cast("long")) * 60 + part(3).cast("long")) * 60 + part(4).cast("long")
    return F.when(text.rlike(form), whole * 1_000_000 + F.rpad(part(5), 6, "0").cast("long"))
