"""Quality rules: counts of a text, and a linear-chain conditional random field that labels its lines."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busframe.llm.common import ASCII_SPACE, begun, map_rows, plain, sliced, trimmed

SYMBOLS = "#*$%&|<>"
#: The field is fitted on at most this many labelled documents of at most so many characters and lines each.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 20_000
SAMPLE_LINES = 300
CONTENT_SHARE = 0.5
LABELS = ("boilerplate", "content")


def counts(text: str) -> dict[str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    n_repeat = 0
    if n > 5:
        ids: dict[bytes, int] = {}
        w = [ids.setdefault(x, len(ids)) for x in words]
        if len(ids) < n:
            windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
            if len(set(windows)) < len(windows):
                often = Counter(windows)
                hit = bytearray(n)
                for k, x in enumerate(windows):
                    if often[x] > 1:
                        hit[k : k + 5] = b"\1\1\1\1\1"
                n_repeat = hit.count(1)
    return {"n_words": n, "word_chars": len(text) - sum(map(text.count, ASCII_SPACE)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


N_FEATURES = 10


def line_features(line: str, seen: set[str]) -> tuple[list[float], int]:
    """Features of a line with a word and its words; seen: the lines before it."""
    words = line.split()
    n = len(words)
    chars = len(line) - line.count(" ")
    upper = sum(1 for x in words if x.isupper() and len(x) > 1) / n
    marks = sum(map(line.count, SYMBOLS))
    distinct = len(set(words)) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    f = [
        1.0,
        float(n < 5),
        upper,
        min(1.0, 4 * marks / chars),
        float(line.count("|") > n / 8),
        min(1.0, 2.0 * line.count("!") / n),
        1 - distinct if n >= 8 else 0.0,
        same,
        float(line in seen),
        min(2.0, chars / n / 8),
    ]
    seen.add(line)
    return f, n


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and words of each line with a word."""
    seen: set[str] = set()
    rows = [line_features(x, seen) for x in text.split("\n") if x.split()]
    return np.array([r[0] for r in rows], np.float64).reshape(-1, N_FEATURES), np.array([r[1] for r in rows], np.int64)


class Field:
    """A linear-chain conditional random field with the labels of LABELS: emissions from features, and transitions."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the most probable labels of a sequence; at a tie, content."""
        emit = (x @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.transitions.tolist()
        back = []
        a, b = emit[0]
        for e0, e1 in emit[1:]:
            p0, p1 = b + t10 >= a + t00, b + t11 >= a + t01
            back.append((p0, p1))
            a, b = (b + t10 if p0 else a + t00) + e0, (b + t11 if p1 else a + t01) + e1
        out = [int(b >= a)]
        for p in reversed(back):
            out.append(int(p[out[-1]]))
        return np.array(out[::-1])

    @staticmethod
    def fit(sequences: list[np.ndarray], labels: list[int], rounds: int = 150, l2: float = 1e-3) -> Field:
        """Maximum likelihood by gradient steps, lines of a document bearing its label.

        Sequences are padded to batches of like length; forward-backward runs over all of a batch at once."""
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        batches = []
        for at in range(0, len(order), 256):
            ks = [k for k in order[at : at + 256] if len(sequences[k])]
            if not ks:
                continue
            size = max(len(sequences[k]) for k in ks)
            x, mask, y = np.zeros((len(ks), size, N_FEATURES)), np.zeros((len(ks), size), bool), np.array([labels[k] for k in ks])
            for r, k in enumerate(ks):
                x[r, : len(sequences[k])] = sequences[k]
                mask[r, : len(sequences[k])] = True
            batches.append((x, mask, y))
        w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        mw, mt, vw, vt = np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)
        total = sum(m.sum() for _, m, _ in batches) or 1
        for step in range(1, rounds + 1):
            gw, gt = l2 * w, l2 * t
            for x, mask, y in batches:
                e = x @ w
                n, size = mask.shape
                alpha, beta = np.zeros((n, size, 2)), np.zeros((n, size, 2))
                alpha[:, 0] = e[:, 0]
                for k in range(1, size):
                    now = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t, axis=1) + e[:, k]
                    alpha[:, k] = np.where(mask[:, k, None], now, alpha[:, k - 1])
                for k in range(size - 2, -1, -1):
                    now = np.logaddexp.reduce(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
                    beta[:, k] = np.where(mask[:, k + 1, None], now, 0.0)
                z = np.logaddexp.reduce(alpha[:, -1], axis=1)
                p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
                truth = np.zeros_like(p)
                truth[np.arange(n), :, y] = mask
                gw += np.einsum("nkf,nkl->fl", x, p - truth) / total
                if size > 1:
                    pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
                    gt += pair.sum((0, 1)) / total
                    for label in (0, 1):
                        gt[label, label] -= mask[y == label, 1:].sum() / total
            for g, m, v, target in ((gw, mw, vw, w), (gt, mt, vt, t)):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                target -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return Field(w, t)


def _features(batches):
    for batch in batches:
        x = [features(t)[0] for t in batch.column("text").to_pylist()]
        yield {"quality": batch.column("quality").to_pylist(), "x": [v.astype("<f8").tobytes() for v in x]}


def fit_field(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_lines: int = SAMPLE_LINES) -> Field:
    """The field fitted on a sample of labelled rows: those of docs with a quality label whose ids hash lowest.

    The sample is bounded by sample_docs documents of sample_chars characters and sample_lines lines, whatever the size
    of docs; the driver gets at most sample_docs * sample_lines * N_FEATURES numbers. Of labels that share a doc_id the
    least counts, of documents that do the least text. Without labelled rows of both kinds the field has no weights,
    and all lines are content."""
    labelled = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("rid")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    few = labelled.orderBy(F.xxhash64("rid"), "rid").limit(sample_docs)
    base = plain(docs)[0].select("id", "text")
    rows = base.join(F.broadcast(few), F.col("id") == F.col("rid")).filter((F.length("text") <= sample_chars) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < sample_lines))  # few has at most sample_docs rows
    once = rows.groupBy("rid").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    found = map_rows(once.select("quality", "text"), _features, "quality int, x binary").collect()
    found.sort(key=lambda r: (r["quality"], bytes(r["x"])))
    if len({r["quality"] for r in found}) < 2:
        return Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    return Field.fit([np.frombuffer(bytes(r["x"]), "<f8").reshape(-1, N_FEATURES) for r in found], [r["quality"] for r in found])


def judged(text: str, field: Field, share: float = CONTENT_SHARE) -> dict:
    """The counts of a text, base_failed, content_share (of words, in lines labelled content) and kept."""
    c: dict = counts(text)
    failed = base_failed(c)
    x, n = features(text)
    content = float(n[field.decode(x) == 1].sum() / n.sum()) if len(n) else 0.0
    return c | {"base_failed": failed, "content_share": content, "kept": not failed and content >= share}


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]


def quality_rules(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """One row for each row of docs: doc_id and the columns of judged().

    A null or empty text has no words, fails the base and isn't kept. doc_id may be null or repeat. An empty table
    gives no rows. Without usable labels the base alone decides."""
    field = fit_field(docs, labels)

    def run(batches):
        for batch in batches:
            found = [judged(t, field, share) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("id").to_pylist()} | {c: [x[c] for x in found] for c in COLUMNS}

    return map_rows(plain(docs)[0].select("id", "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs that quality_rules keeps, in the same columns."""
    import pyarrow as pa

    field = fit_field(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        begun(__name__)
        for batch in sliced(batches):
            yield batch.filter(pa.array([judged(t or "", field, share)["kept"] for t in batch.column(at).to_pylist()], pa.bool_()))
        trimmed()

    return docs.mapInArrow(run, docs.schema)
