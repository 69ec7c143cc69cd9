"""Token counts that follow edits: a segment tree over each document's pre-tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busframe.llm.byte_ids import EXACT, ByteIds, byte_ids, pretokens
from busframe.llm.common import map_rows, plain

LEAF = 32
#: A leaf of more pre-tokens than this makes the tree be laid out anew.
LARGEST = 8 * LEAF


class CountedText:
    """A text whose token count is kept through edits.

    Leaves hold runs of pre-tokens; inner nodes the sums of characters and tokens below them. An edit finds its
    leaves by the sums of characters, cuts pre-tokens anew from the last boundary that the edit can't have moved to
    the first old boundary met again behind it, encodes these alone, and renews the sums above the leaves."""

    def __init__(self, text: str, ids: ByteIds):
        self.ids, self.reencoded = ids, 0
        parts = pretokens(text)
        self._lay(parts, list(map(ids.size, parts)))

    def _lay(self, parts: list[str], sizes: list[int]) -> None:
        self.parts = [parts[k : k + LEAF] for k in range(0, len(parts), LEAF)] or [[]]
        self.sizes = [sizes[k : k + LEAF] for k in range(0, len(parts), LEAF)] or [[]]
        self.width = 1 << (len(self.parts) - 1).bit_length()
        pad = [0] * (self.width - len(self.parts))
        self.chars = [0] * self.width + [sum(map(len, p)) for p in self.parts] + pad
        self.tokens = [0] * self.width + [sum(s) for s in self.sizes] + pad
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.parts for p in leaf)

    def _leaf(self, pos: int) -> tuple[int, int]:
        """The leaf with the character at pos (the last one for the end), and where it begins."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if pos >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _renew(self, leaf: int) -> None:
        node = leaf + self.width
        self.chars[node], self.tokens[node] = sum(map(len, self.parts[leaf])), sum(self.sizes[leaf])
        while node := node // 2:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, pos: int, n_del: int, new: str) -> None:
        """Replaces n_del characters from pos on; both are cut to the text."""
        pos = min(max(pos, 0), self.n_chars)
        n_del = min(max(n_del, 0), self.n_chars - pos)
        # A pre-token's end depends on at most two characters behind it.
        leaf, start = self._leaf(max(0, pos - 2))
        keep = 0
        for p in self.parts[leaf]:
            if start + len(p) > pos - 2:
                break
            start += len(p)
            keep += 1
        # The old text from start on, leaf by leaf, until an old boundary behind the edit is met.
        last, old, ends, at = leaf, [], [], start
        old += self.parts[leaf][keep:]
        reach = 1
        while True:
            while last + 1 < len(self.parts) and (sum(map(len, old)) < pos + n_del - start + 2 or reach > 1):
                last += 1
                old += self.parts[last]
                reach -= self.chars[last + self.width] > 0
                if reach < 1:
                    break
            joined = "".join(old)
            window = joined[: pos - start] + new + joined[pos - start + n_del :]
            whole = last + 1 >= len(self.parts) or not any(self.chars[k + self.width] for k in range(last + 1, len(self.parts)))
            ends, at = {}, start
            for k, p in enumerate(old):
                at += len(p)
                ends[at] = k + 1
            shift = len(new) - n_del
            parts, met = [], None
            for m in EXACT.finditer(window):
                end = start + m.end()
                if not whole and m.end() > len(window) - 2:
                    break
                parts.append(m[0])
                if end >= pos + len(new) and end - shift >= pos + n_del and end - shift in ends:
                    met = ends[end - shift]
                    break
            if met is None and whole:
                met = len(old)
            if met is not None:
                break
            reach = 2 + len(old) // LEAF
        sizes = list(map(self.ids.size, parts))
        self.reencoded += len(parts)
        rest_sizes = (self.sizes[leaf][keep:] + [s for k in range(leaf + 1, last + 1) for s in self.sizes[k]])[met:]
        self.parts[leaf] = self.parts[leaf][:keep] + parts + old[met:]
        self.sizes[leaf] = self.sizes[leaf][:keep] + sizes + rest_sizes
        for k in range(leaf + 1, last + 1):
            self.parts[k], self.sizes[k] = [], []
        if len(self.parts[leaf]) > LARGEST:
            self._lay([p for x in self.parts for p in x], [s for x in self.sizes for s in x])
        else:
            for k in range(leaf, last + 1):
                self._renew(k)


def _counts(vocabulary: str | None):
    def run(batches):
        own = byte_ids(vocabulary)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded")}
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                doc = CountedText(text, own)
                out["n_tokens"].append(doc.n_tokens)
                out["n_pretokens"].append(sum(map(len, doc.parts)))
                edits = [e for e in edits or [] if e is not None]
                for e in edits:
                    doc.edit(e["pos"] or 0, e["n_del"] or 0, e["new"] or "")
                out["n_edits"].append(len(edits))
                out["n_tokens_after"].append(doc.n_tokens)
                out["n_chars_after"].append(doc.n_chars)
                out["n_reencoded"].append(doc.reencoded)
            yield {"doc_id": batch.column("id").to_pylist(), **out}

    return run


def edited_counts(docs: DataFrame, edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_chars_after, n_reencoded.

    edits names a column of docs, an array of structs pos, n_del, new, applied in order; places are code points of
    the text as the edits before left it, cut to its ends. Null edits, or nulls in one, change nothing. A null text
    is empty and has no tokens. doc_id may be null or repeat. An empty table gives no rows."""
    base, _ = plain(docs)
    return map_rows(base.select("id", "text", F.col(f"c{docs.columns.index(edits)}").alias("edits")), _counts(vocabulary), "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_tokens_after long, n_chars_after long, n_reencoded long")


def sample_edits(text: str = "text"):
    """Three edits for any text: words put into the middle, a cut at a third, a line added at the end."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    edit = lambda pos, n_del, new: F.struct(pos.cast("int").alias("pos"), F.lit(n_del).alias("n_del"), F.lit(new).alias("new"))
    return F.array(edit(F.floor(n / 2), 3, "new words, 42 of them"), edit(F.floor(n / 3), 40, ""), edit(n + 100, 0, "\n  one more line"))
