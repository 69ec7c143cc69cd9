"""Secret scans in DataFrame functions: patterns, and windows of high entropy in candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busframe.llm.common import plain

_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
NAMES = "|".join([*map(_ANY, ("password", "passwd", "secret", "token")), f"{_ANY('api')}_?{_ANY('key')}"])
ASSIGN = f"({NAMES})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
#: Candidate strings: runs of these characters; WINDOW of them are looked at at a time.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABETS = {"entropy_hex": "0123456789abcdef", "entropy_b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}
#: Bits a character in the best window, by character class.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_b64": 3.7}
#: Strings that hold one of these, in any case, are examples or counters and no secrets.
ALLOWED = ("example", "sample", "placeholder", "changeme", "change_me", "dummy", "redacted", "yourkey", "your_key", "your-key", "abcdefghij", "0123456789", "1234567890", "xxxxxxxx", "00000000")

#: start, kind's rank and end in code points; begin and stop are the same places in bytes of UTF-8.
SPAN = "struct<start:int,rank:int,end:int,begin:int,stop:int>"
#: Long arrays are folded in blocks of so many items, so that what a fold gathers isn't copied whole for each item.
BLOCK = 256


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it, also in functions that f hands on."""
    return F.get(F.transform(F.array(value), f), 0)


def gathered(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The struct (state, out) after items went through step in order: a new state and an array of what is put out.

    items is an array. Time grows with the items and not with their square."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(own: Column, acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(own, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    first = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    blocks = lambda own: F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int"))
    fold = lambda own: F.aggregate(blocks(own), first, lambda acc, k: block(own, acc, k), lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))
    return bound(items, lambda own: F.when(F.size(own) > 0, fold(own)).otherwise(F.struct(start.alias("state"), none.alias("out"))))


def _spans(text: Column, found: Column, pattern: str, rank: int) -> Column:
    """Spans of the matches `found` of pattern in text, from the lengths of what lies between and in them."""
    pairs = bound(F.split(text, pattern, -1), lambda gaps: F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        begin, byte = state["at"] + F.length(x["gap"]), state["byte"] + F.octet_length(x["gap"])
        end, stop = begin + F.length(x["hit"]), byte + F.octet_length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), byte.alias("begin"), stop.alias("stop"))
        return F.struct(end.alias("at"), stop.alias("byte")), F.array(span)

    return F.when(F.size(found) > 0, gathered(pairs, start, step, SPAN)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_entropy(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits a character, of any `window` neighbouring characters of string; 0 if it is shorter.

    Counts of the characters in the window and the sum of n log2 n over them are kept up as it slides: one character
    comes in, one goes out, and only their two counts are written. The counts are a string with a character for each
    of the alphabet's, and one more for all others. Time grows with the length of the string."""
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    count = lambda counts, code: F.ascii(F.substr(counts, code + 1, F.lit(1))) - ord("0")
    put = lambda counts, code, n: F.overlay(counts, F.chr(n + ord("0")), code + 1, F.lit(1))
    start = F.struct(F.lit("0" * (len(alphabet) + 1)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def slide(codes: Column, acc: Column, k: Column) -> Column:
        def gone(m: Column, go: Column) -> Column:
            return F.struct(put(acc["counts"], go, m - 1).alias("counts"), (acc["total"] - term(m) + term(m - 1)).alias("total"))

        def come(left: Column) -> Column:
            code = F.get(codes, k)
            n = count(left["counts"], code)
            return bound(n, lambda n: F.struct(put(left["counts"], code, n + 1).alias("counts"), (left["total"] - term(n) + term(n + 1)).alias("total")))

        less = F.when(k >= window, bound(F.get(codes, k - window), lambda go: bound(count(acc["counts"], go), lambda m: gone(m, go)))).otherwise(F.struct(acc["counts"].alias("counts"), acc["total"].alias("total")))
        now = lambda x: F.when(k >= window - 1, F.lit(math.log2(window)) - x["total"] / window).otherwise(F.lit(0.0))
        return bound(less, lambda left: bound(come(left), lambda x: F.struct(x["counts"].alias("counts"), x["total"].alias("total"), F.greatest(acc["best"], now(x)).alias("best"))))

    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c))
    best = lambda own: F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), start, lambda acc, k: slide(own, acc, k), lambda acc: acc["best"])
    return F.when(F.length(string) >= window, bound(codes, best)).otherwise(F.lit(0.0))


def _entropic(string: Column) -> Column:
    """The rank of a candidate's kind if it looks random, else null."""
    allowed = string.rlike("(?i)" + "|".join(ALLOWED))
    is_hex = string.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    mixed = string.rlike("[0-9]") & string.rlike("[A-Za-z]")
    hexes = window_entropy(F.lower(string), ALPHABETS["entropy_hex"]) >= THRESHOLDS["entropy_hex"]
    others = window_entropy(string, ALPHABETS["entropy_b64"]) >= THRESHOLDS["entropy_b64"]
    return F.when(~mixed | allowed, F.lit(None)).when(is_hex, F.when(hexes, F.lit(3))).when(others, F.lit(4)).cast("int")


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """df (columns c0, ..., id, text) with base and all, arrays of spans, by start and rank."""
    none = F.array().cast(f"array<{SPAN}>")
    out = df.withColumns({
        "m_assign": F.regexp_extract_all(text, F.lit(ASSIGN), 0),
        "m_access": F.regexp_extract_all(text, F.lit(ACCESS), 0),
        "m_hex": F.regexp_extract_all(text, F.lit(HEX), 0),
        "m_run": F.regexp_extract_all(text, F.lit(CANDIDATE), 0),
    })
    col = F.col
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    long = lambda own: F.transform(F.filter(own, lambda x: F.length(x["v"]) >= ASSIGN_LEAST), lambda x: x["s"])
    assign = F.when(F.size("m_assign") > 0, bound(F.arrays_zip(_spans(col(text), col("m_assign"), ASSIGN, 0).alias("s"), values.alias("v")), long)).otherwise(none)
    ranks = F.when(F.size("m_run") > 0, F.transform(col("m_run"), _entropic)).otherwise(F.array().cast("array<int>"))
    out = out.withColumns({"s_assign": assign, "s_access": _spans(col(text), col("m_access"), ACCESS, 1), "s_hex": _spans(col(text), col("m_hex"), HEX, 2), "r_run": ranks})
    out = out.withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex")))
    random = lambda own: F.transform(F.filter(own, lambda x: x["r"].isNotNull()), lambda x: x["s"].withField("rank", x["r"]))
    extra = F.when(F.exists("r_run", lambda r: r.isNotNull()), bound(F.arrays_zip(_spans(col(text), col("m_run"), CANDIDATE, 3).alias("s"), col("r_run").alias("r")), random)).otherwise(none)
    out = out.withColumn("extra", extra)

    def fresh(reach: Column, x: Column) -> tuple[Column, Column]:
        """A span of the method goes if a base span that begins no later reaches its end; base spans of a place come first."""
        own = x["rank"] < 3
        return F.when(own, F.greatest(reach, x["end"])).otherwise(reach), F.when(own | (reach < x["end"]), F.array(x)).otherwise(none)

    every = gathered(F.array_sort(F.concat("base", "extra")), F.lit(0), fresh, SPAN)["out"]
    out = out.withColumn("all", F.when(F.size("extra") > 0, every).otherwise(col("base")))
    return out.drop("m_assign", "m_access", "m_hex", "m_run", "r_run", "extra", "s_assign", "s_access", "s_hex")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are those of the three patterns. A candidate string whose best window reaches its class's entropy is
    added as a span, unless it lies in a base span, has no digit or no letter, or holds an allow-listed string. Spans
    are kind:start:end in code points, end exclusive, by start and then kind. A null text is empty and has none.
    doc_id may be null or repeat. An empty table gives no rows."""
    base, _ = plain(docs)
    found = with_spans(base.select("id", "text"), "text")
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))


MASK = "[SECRET]"


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with each span of secret_scan in text replaced by mask; spans that overlap are one. Null texts stay null."""
    base, own = plain(docs)
    found = with_spans(base, "text")
    at = docs.columns.index("text")

    def masked(data: Column) -> Column:
        """The text in bytes, cut by the spans' places in bytes, as a place is found at once there."""
        part = lambda begin, stop: F.substring(data, begin + 1, stop - begin).cast("string")

        def step(reach: Column, x: Column) -> tuple[Column, Column]:
            return F.greatest(reach, x["stop"]), F.when(x["begin"] >= reach, F.array(part(reach, x["begin"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))

        return bound(gathered(F.col("all"), F.lit(0), step, "string"), lambda x: F.concat(F.array_join(x["out"], ""), part(x["state"], F.octet_length(data))))

    columns = own(found)
    columns[at] = F.when(F.size("all") > 0, bound(F.col("text").cast("binary"), masked)).otherwise(F.col(f"c{at}")).alias("text")
    return found.select(*columns)
