"""Ids of the public byte-level vocabulary, word by word, as the tokenizers library gives them."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

from busframe.llm.common import Cache, forgets

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of the caches of words behind a space, of other words and of pre-tokens; what an entry takes beside its text and ids.
SPACED, BARE, SIZES = 160 << 20, 48 << 20, 128 << 20
ENTRY = 190
#: Marks that end a word and are a pre-token of their own behind letters.
MARKS = ".,;:!?"
#: Texts of these characters alone are cut alike by the faster of the two patterns.
PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ƺ‘’“”–—…€]")
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
EXACT = regex.compile(public_tokenizers.PATTERN)
WHITE = re.compile(r"\s")
#: The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
ALPHABET = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}


class ByteIds:
    """Words are cut at single spaces and line feeds, where pre-tokens always end; a text with any longer run of
    white space, or with any other white space, goes to the library whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.bare, self.spaced, self.sizes = Cache(BARE), Cache(SPACED), Cache(SIZES)
        self.newline = self.pack("\n")

    def pack(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def pack_letters(self, text: str) -> bytes:
        """The same for letters with at most one space in front, which are one pre-token and go straight to the model."""
        ids = [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(ALPHABET))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, held: Cache, word: str, front: str) -> bytes | None:
        stem = word.rstrip(MARKS)
        if word.isalpha():
            out = self.pack_letters(front + word)
        elif stem.isalpha():
            first = held[stem] if stem in held else self._word(held, stem, front)
            tail = word[len(stem) :]
            out = first + (self.bare[tail] if tail in self.bare else self._word(self.bare, tail, ""))
        else:
            out = None if not word or WHITE.search(word) else self.pack(front + word)
        # A word of another width takes up to four bytes a character.
        return held.hold(word, out, ENTRY + len(word) * (1 if word.isascii() else 4) + len(out or b""))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes | None] = []
        bare, spaced = self.bare, self.spaced
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            first, *words = line.split(" ")
            try:
                out.append(bare[first])
            except KeyError:
                out.append(self._word(bare, first, ""))
            try:
                out += list(map(spaced.__getitem__, words))
            except KeyError:
                out += [spaced[w] if w in spaced else self._word(spaced, w, " ") for w in words]
            if out[-1] is None:
                return self.pack(text)
        try:
            return b"".join(out)
        except TypeError:
            return self.pack(text)

    def size(self, pretoken: str) -> int:
        out = self.sizes.get(pretoken)
        if out is None:
            n = len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
            out = self.sizes.hold(pretoken, n, ENTRY + len(pretoken) * (1 if pretoken.isascii() else 4))
        return out


def pretokens(text: str) -> list[str]:
    return EXACT.findall(text) if PLAIN.search(text) else FAST.findall(text)


@lru_cache(2)
def byte_ids(path: str | None) -> ByteIds:
    return ByteIds(path or public_tokenizers.path(VOCABULARY))


forgets.append(byte_ids.cache_clear)
