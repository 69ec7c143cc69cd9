"""SentencePiece encoding of the merge type by a table of last tokens, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from busframe.llm.common import Cache, forgets, map_rows, plain

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of the caches of chunks behind a space, of other chunks and of pairs; what an entry takes beside its texts.
SPACED, BARE, PAIRS = 128 << 20, 48 << 20, 48 << 20
ENTRY = 190
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6


class _Chunks(Cache):
    """Ids of chunks, as bytes."""

    def __init__(self, make, most):
        super().__init__(most)
        self.make = make

    def __missing__(self, key):
        out = self.make(key)
        return self.hold(key, out, ENTRY + len(out) + len(key) * (1 if key.isascii() else 4))


class Pieces:
    """A model of the merge type with byte fallback, identity normalisation and a leading space.

    Merging a text gives tokens of which each prefix of tokens is the result for the text they cover. So each place
    of a text has one last token, the last of the result for the text up to there: among the pieces that end there
    (matches of an automaton) it is the one that stands alone after merging together with the last token of the
    place where it begins. The table is filled from left to right and read backwards."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        assert model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        assert USER_DEFINED not in kinds and UNUSED not in kinds
        self.ids = {p: k for k, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)) if kind == NORMAL}
        self.score = {p: model.pieces[k].score for p, k in self.ids.items()}
        self.byte = [0] * 256
        out = []
        for k, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte[int(p[3:5], 16)] = k
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(p.replace(SPACE, " ").encode() if kind == NORMAL else b"" if kind == 3 else " ⁇ ".encode())
        self.sizes = np.array([len(x) for x in out])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.bos, self.eos = 1, 2
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.alone: dict[str, bool] = {}
        self.pairs = Cache(PAIRS)
        #: Characters that no longer piece holds; a text can be cut beside them.
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.newline_cuts = "\n" not in inner
        #: Spaces stand only at the front of a piece or make up all of it, so a text can be cut before a run of them.
        assert all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.with_space, self.bare = _Chunks(lambda w: self._bytes(SPACE + w), SPACED), _Chunks(self._bytes, BARE)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        self.newline = self._bytes("\n")

    def merged(self, text: str) -> list[str]:
        """Merging itself: the pair whose piece has the best score goes first, the leftmost at a tie."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a and b together leaves them as they are."""
        out = self.pairs.get((a, b))
        if out is None:
            out = self.pairs.hold((a, b), self.merged(a + b) == [a, b], ENTRY)
        return out

    def stands(self, piece: str) -> bool:
        out = self.alone.get(piece)
        if out is None:
            out = self.alone[piece] = self.merged(piece) == [piece]
        return out

    def tokens(self, text: str) -> list[str]:
        """The last token of each prefix, then the tokens from the end backwards; a character without a piece is itself."""
        last: list[str | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, piece in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - len(piece)
                if start:
                    before = last[start]
                    if before is None:
                        before = last[start] = text[start - 1]  # no piece: nothing merges with it
                    ok = pairs.get((before, piece))
                    if not (self.compatible(before, piece) if ok is None else ok):
                        continue
                elif not self.stands(piece):
                    continue
                last[end + 1] = piece
        out, at = [], len(text)
        while at:
            piece = last[at] or text[at - 1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def _bytes(self, chunk: str) -> bytes:
        ids: list[int] = []
        for p in self.tokens(chunk):
            k = self.ids.get(p)
            if k is None:
                ids += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                ids.append(k)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.newline_cuts or SPACE in text or "  " in text:
            return b"".join(map(self.bare.__getitem__, self.chunk.findall(SPACE + text.replace(" ", SPACE))))
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            words = line.split(" ")
            if k and words[0]:
                out.append(self.bare[words[0]])
            if not k:
                words.insert(0, "")
            if len(words) > 1:
                if "" in words[1:]:
                    rest = line if k else " " + line
                    out.append(b"".join(map(self.bare.__getitem__, self.chunk.findall(rest[len(words[0]) :].replace(" ", SPACE)))))
                else:
                    out.append(b"".join(map(self.with_space.__getitem__, words[1:])))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text with begin and end."""
        return np.concatenate([[self.bos], np.frombuffer(self.encode_bytes(text), "<u4"), [self.eos]]).astype("<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: begin and end go, bytes join, the leading space goes."""
        ids = ids.astype(np.int64)
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        place = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
        out = self.blob[place].tobytes()
        if out[:1] == b" ":
            first = ids[sizes > 0][0]
            if not self.is_byte[first]:
                out = out[1:]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids)).decode("utf-8", "replace")


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


forgets.append(pieces.cache_clear)


def _encode(path: str | None):
    def run(batches):
        own = pieces(path or public_tokenizers.path(MODEL))
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            yield {"doc_id": batch.column("id").to_pylist(), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return run


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs, encoded and decoded again.

    A null text is empty and has the begin and end ids alone. doc_id may be null or repeat. An empty table gives no
    rows. model: path of a model on each machine; by default the public one."""
    return map_rows(plain(docs)[0].select("id", "text"), _encode(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs."""

    def run(batches):
        own = pieces(model or public_tokenizers.path(MODEL))
        for batch in batches:
            yield {"doc_id": batch.column("id").to_pylist(), "ids": [own.encode(t).astype("int32") for t in batch.column("text").to_pylist()]}

    return map_rows(plain(docs)[0].select("id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of each row of encoded (doc_id, ids); null ids give an empty text."""

    def run(batches):
        own = pieces(model or public_tokenizers.path(MODEL))
        for batch in batches:
            yield {"doc_id": batch.column("doc_id").to_pylist(), "text": [own.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
