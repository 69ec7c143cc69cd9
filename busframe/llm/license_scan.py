"""Licence scans: phrases and tags by an Aho-Corasick automaton, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busframe.llm.common import map_rows, plain

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases of licence notices in the words of the scan, and their labels.
NOTICES = {
    "licensed under the apache license": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain dedication": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl-1.0",
    "eclipse public license": "epl",
}
TAG = "spdx license identifier"
TAG_START = re.compile(r"SPDX-License-Identifier[ \t]*:", re.I)
#: What may stand between a tag's expression and the end of its line.
LINE_END = re.compile(r"[^\S\r\n]*[-/>]*[^\S\r\n]*(?:[\r\n*]|\Z)")
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "cc0-1.0", "unlicense", "bsl-1.0", "cc-by-4.0", "cc-by-3.0"}
SCORES = {"base": 0.6, "notice": 0.9, "tag": 1.0}
#: Bytes of a word after lowering: 0-9, a-z and all of 0x80 and above.
TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9.+:_-]+))")
TAG_TOKEN = re.compile(r"[^\S\r\n]*(?:([()])|([A-Za-z0-9.+:_-]+))")
RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: with binds before and, and before or, all to the left. ValueError if it isn't an expression."""
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True
    expression = expression.strip()
    while at < len(expression):
        m = TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"no token at {at}")
        at = m.end()
        token = m[1] or m[2]
        word = token.lower()
        if token == "(":
            if not operand:
                raise ValueError("operator expected")
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError("licence expected")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unmatched )")
            stack.pop()
        elif word in RANK:
            if operand:
                raise ValueError("licence expected")
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            if not operand:
                raise ValueError("operator expected")
            out.append(word)
            operand = False
    if operand:
        raise ValueError("licence expected")
    while stack:
        if stack[-1] == "(":
            raise ValueError("unmatched (")
        out.append(stack.pop())
    return out


def evaluate(expression: str, permissive: set[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """The licences an expression names and whether a user can choose to have permissive ones only.

    An or needs one side, an and both; with keeps its licence's value and names licence and exception together."""
    stack: list[tuple[set[str], bool]] = []
    for token in to_postfix(expression):
        if token not in RANK:
            stack.append(({token}, token in permissive))
            continue
        (b, free_b), (a, free_a) = stack.pop(), stack.pop()
        if token == "with":
            if len(a) != 1 or len(b) != 1:
                raise ValueError("with takes a licence and an exception")
            stack.append(({f"{min(a)} with {min(b)}"}, free_a))
        else:
            # The smaller set joins the larger one in place, so that long expressions don't cost their square.
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
            stack.append((a, free_a or free_b if token == "or" else free_a and free_b))
    return stack[0]


def tag_text(text: str, at: int) -> str:
    """The expression that starts at `at` in text: the longest run of tokens of the line that is complete.

    What can't continue it, as prose behind it, ends it; so does a full stop, colon or dash at a name's end. If the
    line ends in the middle of an expression, all of that is returned, which doesn't parse."""
    start, good, depth, operand = at, at, 0, True
    while m := TAG_TOKEN.match(text, at):
        token, cut = m[1] or m[2], False
        end = m.end()
        if token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif token.lower() in RANK:
            if operand:
                break
            operand = True
        else:
            name = token.rstrip(".:_-")
            if not operand or not name:
                break
            operand, cut, end = False, name != token, m.start(2) + len(name)
        at = end
        if not operand and not depth:
            good = at
        if cut:
            break
    return text[start : at if LINE_END.match(text, at) else good]


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float, bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(TO_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    places: list[int] = []
    base, labels, score, free = set(), set(), 0.0, None
    # Latin-1 gives each byte a character of its own, so that no decoding can fail.
    flat = line.decode("latin-1")
    tagged = False
    for end, phrase in automaton().iter(flat):
        if phrase in BASE:
            places.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
            score = max(score, SCORES["base"])
        elif phrase == TAG:
            tagged = True
            continue
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
            score = max(score, SCORES["notice"])
    if tagged:
        for m in TAG_START.finditer(text):
            try:
                names, ok = evaluate(tag_text(text, m.end()))
            except ValueError:
                continue
            labels |= names
            free = ok if free is None else free and ok
            score = SCORES["tag"]
    first = last = None
    if places:
        first, last = line.count(b" ", 0, min(places) + 1) - 1, line.count(b" ", 0, max(places) + 1) - 1
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels | base)), score, free


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive"]


def _scan(batches):
    for batch in batches:
        found = [scan(t) for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("id").to_pylist()} | dict(zip(COLUMNS, zip(*found), strict=True) if found else {c: [] for c in COLUMNS})


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and the columns of scan().

    A null text is empty: no words, no labels, score 0. A tag's expression is the
    longest complete one behind it on its line; a tag without one, or whose line ends inside one, adds nothing. Repeated
    places count each time, labels once. permissive is null where no tag's expression was evaluated. doc_id may be
    null or repeat. An empty table gives no rows."""
    return map_rows(plain(docs)[0].select("id", "text"), _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean")
