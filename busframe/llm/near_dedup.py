"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busframe.llm.common import HOT_LEAST, HOT_SHARE, Cache, join_by_hash, map_rows, pack_rows, plain, written

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Further coordinates of the nodes in large buckets that have several classes.
FINER = 1024
#: Bytes of the words' hashes that a worker keeps, and what an entry takes beside the word; keys that a task knows.
CACHE, ENTRY = 32 << 20, 170
KEYS = 100_000
#: Buckets of more members have a second turn of centres before their signatures are compared.
SMALL = 64
#: Buckets of more members have turns of centres until one finds no link, so that fewer classes are left to compare.
LARGE = 16_384
#: At last the signatures of different classes are compared in every bucket, in blocks of two parts of so many members.
BLOCK = 1024


def least(n: int) -> int:
    """So many of n coordinates of a pair of similarity SIMILAR agree at least, but for a chance of about 4e-5."""
    return math.floor(n * SIMILAR - 4 * math.sqrt(n * SIMILAR * (1 - SIMILAR)))


M1, M2, G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


_words = Cache(CACHE)


def _hashes(words: list[bytes]) -> np.ndarray:
    held = _words
    try:
        return np.array([held[w] for w in words], np.uint64)
    except KeyError:
        return np.array([held[w] if w in held else held.hold(w, xxhash.xxh64_intdigest(w), ENTRY + len(w)) for w in words], np.uint64)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of SHINGLE words, sorted, and how often each stands; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = _hashes(words)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h += w[k : k + n] * ODD[k]
    return np.unique(mix(h), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of the smaller counts over that of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signature(elements: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """DartMinHash: of each coordinate the earliest dart that hits the weighted set.

    An element of weight w is a column of height w, cut into cells of height 1. Each cell has its own stream of darts
    with unit rate over time, made of hashes of the cell alone; a dart names a coordinate and a height in its cell,
    and hits if the height is below the weight. Only the time in which so many darts are expected to hit that few
    coordinates stay empty is looked at, and more where one is still empty. Two sets share a coordinate's dart with the probability of their
    weighted Jaccard similarity."""
    layers = np.ceil(weights).astype(np.int64)
    layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
    cells = mix(np.repeat(elements, layers) + layer.astype(np.uint64) * G)
    heights = np.repeat(weights, layers) - layer
    until = coordinates * (math.log(coordinates) + 2) / float(weights.sum())
    out, empty = np.zeros(coordinates, np.uint64), np.ones(coordinates, bool)
    while empty.any():
        times, places, names = [], [], []
        now, own, top, step = np.zeros(len(cells)), cells, heights, 0
        while len(own):
            n = max(1, math.ceil(until + 2 * math.sqrt(until))) if not step else max(1, math.ceil(until / 4))
            dart = mix(own[:, None] + np.arange(step + 1, step + n + 1, dtype=np.uint64) * G)
            gap = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            at = now[:, None] + np.cumsum(gap, axis=1)
            hit = at < until
            name = mix(dart[hit] ^ G)
            time = at[hit]
            if (part := np.broadcast_to(top[:, None], hit.shape)[hit]).size and part.min() < 1:
                low = ((mix(name + M1) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < part
                name, time = name[low], time[low]
            times.append(time)
            names.append(name)
            alive = hit[:, -1]
            now, own, top, step = at[alive, -1], own[alive], top[alive], step + n
        time, name = np.concatenate(times), np.concatenate(names)
        places = (name % np.uint64(coordinates)).astype(np.int64)
        order = np.argsort(-time, kind="stable")
        found, some = np.zeros(coordinates, np.uint64), np.zeros(coordinates, bool)
        found[places[order]] = name[order]
        some[places] = True
        out[empty & some] = found[empty & some]
        empty &= ~some
        until *= 2
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash for each band of ROWS coordinates."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * G
    for k in range(ROWS):
        h = mix(h + sig.reshape(BANDS, ROWS)[:, k])
    return h.astype(np.int64)


def short(sig: np.ndarray) -> bytes:
    """The top byte of each coordinate; the lowest bits are the same wherever the coordinate is."""
    return (sig >> np.uint64(56)).astype(np.uint8).tobytes()


def _finer(batches):
    for batch in batches:
        sigs = []
        for text in batch.column("text").to_pylist():
            elements, n = shingles(text.encode("utf-8", "surrogatepass").split())
            sigs.append(short(signature(mix(elements ^ M2), n.astype(np.float64), FINER)))
        yield {"rep": batch.column("id").to_pylist(), "finer": sigs}


def _signed(batches):
    """Of each document its id and content key; where the key is new to the task, also the bands and the short signature."""
    seen: set[bytes] = set()

    def rows():
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                own = top = None
                if key not in seen:
                    if len(seen) > KEYS:
                        seen.clear()
                    seen.add(key)
                    if words:
                        sig = signature(*(lambda h, n: (h, n.astype(np.float64)))(*shingles(words)))
                        own, top = bands(sig), short(sig)
                yield i, key, own, top

    yield from pack_rows(rows(), ["id", "key", "bands", "sig"], 1024)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the coordinates (bytes, one row a node) agree, for each row of a and each of b."""
    out = np.empty((len(a), len(b)), np.uint8)
    for k in range(0, len(a), 16):
        same = (a[k : k + 16, None, :] == b[None]).view(np.uint64).sum(axis=2)
        out[k : k + 16] = (same * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out


def _close(batches):
    """Pairs of different classes whose signatures agree as those of links do, of sorted blocks (h, i, j) of members.

    A block compares the members of part i with those of part j. A pair that shares several buckets comes from the one
    of the smallest h alone."""

    def pairs(block, rows):
        h, i, j = block
        left, right = [r for r in rows if r["part"] == i], [r for r in rows if r["part"] == j]
        if not left or not right:
            return
        roots = [np.array([r["root"] for r in x]) for x in (left, right)]
        found, n = np.unique(np.concatenate(roots), return_counts=True)
        if len(found) < 2:
            return
        most = found[n.argmax()]
        sigs = [np.frombuffer(b"".join(r["sig"] for r in x), np.uint8).reshape(len(x), COORDINATES) for x in (left, right)]
        # Members of the largest class needn't be compared with each other.
        for x, y in ((np.flatnonzero(roots[0] != most), np.arange(len(right))), (np.flatnonzero(roots[0] == most), np.flatnonzero(roots[1] != most))):
            near = (agreeing(sigs[0][x], sigs[1][y]) >= least(COORDINATES)) & (roots[0][x][:, None] != roots[1][y])
            for k, m in zip(*(z.tolist() for z in np.nonzero(near)), strict=True):
                a, b = left[x[k]], right[y[m]]
                if (i != j or a["rep"] < b["rep"]) and min(a["hs"] & b["hs"]) == h and finely(a, b):
                    yield min(a["rep"], b["rep"]), max(a["rep"], b["rep"])

    def finely(a, b):
        if a["finer"] is None or b["finer"] is None:
            return True
        both = [np.frombuffer(x["sig"] + x["finer"], np.uint8) for x in (a, b)]
        return np.count_nonzero(both[0] == both[1]) >= least(COORDINATES + FINER)

    def rows():
        at, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (block := (r["h"], r["i"], r["j"])) != at:
                    yield from pairs(at, held) if held else ()
                    at, held = block, []
                r["hs"] = frozenset(r["hs"])
                held.append(r)
        yield from pairs(at, held) if held else ()

    yield from pack_rows(rows(), ["p", "b"])


def _verified(batches):
    at, own = None, None
    for batch in batches:
        sims = []
        for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("p", "text_p", "text_b")), strict=True):
            if (p, len(a)) != at:
                at, own = (p, len(a)), shingles(a.encode("utf-8", "surrogatepass").split())
                text = a
            elif a != text:
                own, text = shingles(a.encode("utf-8", "surrogatepass").split()), a
            sims.append(similarity(own, shingles(b.encode("utf-8", "surrogatepass").split())))
        yield {"p": batch.column("p").to_pylist(), "b": batch.column("b").to_pylist(), "sim": sims}


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of the documents that pairs (p, b) name; written. The texts are shuffled by id at every size."""
    ids = pairs.select(F.explode(F.array("p", "b")).alias("id")).distinct()
    return written(docs.select("id", "text").join(ids.hint("merge"), "id", "left_semi"), "texts")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """p, b and similarity of pairs (p, b), with texts (id, text); written.

    A p with many pairs is split: its pairs are dealt over salts and its text goes to each. The list of such p has at
    most 1 / HOT_SHARE rows."""
    most = max(HOT_LEAST, int(pairs.count() * HOT_SHARE))
    hot = pairs.groupBy("p").count().filter(F.col("count") > most).select(F.col("p").alias("hot_p"), F.ceil(F.col("count") / most).cast("int").alias("salts"))
    hot = written(hot, "hot")
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    right = right.join(F.broadcast(hot), F.col("p") == F.col("hot_p"), "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("salts"))).cast("int"))
    left = texts.join(F.broadcast(hot), F.col("id") == F.col("hot_p"), "left").select(F.col("id").alias("p"), F.col("text").alias("text_p"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = left.hint("merge").join(right.select("p", "b", "text_b", "salt"), ["p", "salt"])
    return written(map_rows(both.select("p", "b", "text_p", "text_b"), _verified, "p long, b long, sim double"), "sims")


def followed(roots: DataFrame, then: DataFrame) -> DataFrame:
    """roots (node, root) with to, the root that then (node, root) has for their root; null if it has none.

    A root of many nodes is a hot key: its rows are dealt out and its one row of then is broadcast."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    right = then.select(F.col("node").alias("root"), F.col("root").alias("to")).join(sizes, "root")
    return join_by_hash(roots, right, "root", "n", roots.count(), F.col("node")).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected with) of each node of edges (u, v).

    A round points each node at its smallest neighbour, follows pointers, and puts roots for nodes in the edges; what
    is left between different roots is the next round's graph. Each round is written to the shared folder."""
    left = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    out = None
    while not left.isEmpty():
        ways = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = written(ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "parents")
        while True:
            jumped = written(followed(parents, parents).select("node", F.col("to").alias("root"), (F.col("to") != F.col("root")).alias("moved")), "jumped")
            parents = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        a = parents.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = parents.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = written(left.join(a, "u").join(b, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        if out is None:
            out = parents
        else:
            out = written(followed(out, parents).select("node", F.coalesce("to", "root").alias("root")), "roots")
    return left.sparkSession.createDataFrame([], "node long, root long") if out is None else out


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links (p, b) have joined the classes they connect; written."""
    a, b = roots.select(F.col("node").alias("p"), F.col("root").alias("u")), roots.select(F.col("node").alias("b"), F.col("root").alias("v"))
    then = components(links.join(a, "p").join(b, "b").select("u", "v"))
    return written(followed(roots, then).select("node", F.coalesce("to", "root").alias("root")), "roots")


def mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """h, m, rep and root of the members of those buckets that have more than one class; written."""
    tagged = written(members.select("h", "m", "rep").join(roots.withColumnRenamed("node", "rep"), "rep").select("h", "m", "rep", "root"), "tagged")
    several = tagged.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("h", "n")
    return written(join_by_hash(tagged, several, "h", "n", tagged.count(), F.col("rep")).filter("n is not null").drop("n"), "mixed")


def starred(now: DataFrame, turn: int) -> DataFrame:
    """Pairs (p, b) of centres of each bucket with its members of other classes: at first the member of the smallest
    id is the centre, then two others each turn."""
    by = F.xxhash64("h", F.lit(turn)) if turn else F.lit(0).cast("long")
    one = F.struct(F.col("rep").bitwiseXOR(by).alias("r"), "rep", "root")
    centres = now.groupBy("h").agg(F.array(F.min(one), F.max(one)).alias("x") if turn else F.array(F.min(one)).alias("x"), F.count("*").alias("n"))
    met = join_by_hash(now, centres, "h", "n", now.count(), F.col("rep")).select("rep", "root", F.explode("x").alias("x"))
    pairs = met.select("rep", "root", F.col("x.rep").alias("q"), F.col("x.root").alias("q_root")).filter("root <> q_root")
    return pairs.select(F.least("rep", "q").alias("p"), F.greatest("rep", "q").alias("b")).distinct()


def close(now: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (p, b) of members of different classes whose signatures agree as those of links do.

    A bucket is cut into parts of about BLOCK members, and each two parts meet in a block of their own. Nodes in buckets
    of more than SMALL members get FINER more coordinates, as there most pairs are a little below SIMILAR."""
    large = now.filter(F.col("m") > SMALL).select(F.col("rep").alias("id")).distinct()
    finer = map_rows(texts.join(large.hint("merge"), "id", "left_semi"), _finer, "rep long, finer binary")
    finer = written(finer.groupBy("rep").agg(F.first("finer").alias("finer")), "finer")
    own = now.groupBy("rep").agg(F.collect_set("h").alias("hs")).join(nodes.select("rep", "sig"), "rep").join(finer, "rep", "left")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = now.join(own, "rep").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(BLOCK)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "root", "sig", "finer", "hs")
    return map_rows(dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j"), _close, "p long, b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For docs (id, text): each row's id and content key; and of each key the class and its number of rows.

    Copies are one node, named by their smallest id. The nodes that share a band are a bucket. Links are pairs of
    similarity SIMILAR or more, found in turns: in each, one or two members of each bucket are compared with the bucket's
    members of other classes, and classes that a link connects become one. Buckets of at most SMALL members have one
    turn, those of at most LARGE two, larger ones go on until a turn finds no link. At last, in buckets of every size,
    the signatures of what is still apart are compared in blocks, and pairs that agree enough are verified. The turns
    only save comparisons: members of a class aren't compared once they are known to be in it. A bucket that stays in
    many classes costs the square of its members in comparisons of signatures, and each member goes to m / BLOCK blocks."""
    signed = written(map_rows(docs, _signed, "id long, key binary, bands array<long>, sig binary"), "signatures")
    nodes = written(signed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("bands", ignorenulls=True).alias("bands"), F.first("sig", ignorenulls=True).alias("sig")), "nodes")
    placed = nodes.filter("rep is not null and bands is not null").select("rep", F.explode("bands").alias("h")).distinct()
    # Buckets of the same members, as bands of very similar texts make them, are one: their pairs are the same.
    own = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in range(2)]
    buckets = placed.groupBy("h").agg(F.count("*").alias("m"), *own).filter("m > 1")
    firsts = written(buckets.groupBy("m", "x0", "x1").agg(F.min("h").alias("h")).select("h", "m"), "firsts")
    members = written(join_by_hash(placed, firsts, "h", "m", nodes.count() * BANDS, F.col("rep")).filter("m is not null").select("h", "rep", "m"), "members")
    roots = written(members.select(F.col("rep").alias("node"), F.col("rep").alias("root")).distinct(), "roots")
    texts = texts_of(members.select(F.col("rep").alias("p"), F.col("rep").alias("b")), docs)
    most = members.agg(F.max("m")).first()[0] or 0
    seen, turn, found = None, 0, True
    while True:
        last = turn > 0 and (most <= (SMALL if turn == 1 else LARGE) or not found)
        if last:
            now = mixed(members, roots)
        elif turn:
            now = mixed(members.filter(F.col("m") > (SMALL if turn == 1 else LARGE)), roots)
        else:
            now = members.withColumn("root", F.col("rep"))
        pairs = close(now, nodes, texts) if last else starred(now, turn)
        pairs = written(pairs if seen is None else pairs.join(seen, ["p", "b"], "left_anti"), "pairs")
        sims = verify(pairs, texts)
        links = sims.filter(F.col("sim") >= SIMILAR)
        found = not links.isEmpty()
        if found:
            roots = merged(roots, links)
        if last:
            break
        seen = sims.select("p", "b") if seen is None else seen.unionAll(sims.select("p", "b"))
        turn += 1
    named = nodes.select("key", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return signed.select("id", "key"), written(named.select("key", F.coalesce("root", "rep").alias("class_id"), "n"), "classes")


def numbered(base: DataFrame) -> tuple[DataFrame, int | None]:
    """base (id and others) with node: the id, or a number of its own above all ids where that is null; and how much
    smaller nodes are than ids, or None if no id is null.

    Rows with a null id are numbered by partition and place, from a table of one row a partition. Nodes are smaller
    than ids only as far as there is no room above the largest id. ValueError if there is none below either."""
    top, low, some = base.agg(F.max("id"), F.min("id"), F.count(F.when(F.col("id").isNull(), 1))).first()
    if not some:
        return base.withColumn("node", F.col("id")), None
    rows = written(base.withColumn("at", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), "numbered")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for k, n in sorted(rows.filter("at is not null").groupBy(part.alias("part")).agg(F.max(place) + 1).collect()):
        offsets.append((k, total))
        total += n
    first = 0 if top is None else top + 1
    shift = max(0, first + total - (1 << 63))
    if low is not None and low - shift < -(1 << 63):
        raise ValueError("doc_id leaves no numbers for the rows without one")
    offsets = rows.sparkSession.createDataFrame(offsets, "part long, offset long")
    rows = rows.join(F.broadcast(offsets), part == F.col("part"), "left")
    node = F.coalesce(F.col("id") - F.lit(shift).cast("long"), F.lit(first - shift).cast("long") + F.col("offset") + place)
    return rows.withColumn("node", node).drop("at", "part", "offset"), shift


def decided(rows: DataFrame) -> DataFrame:
    """node, root (the smallest node of its class) and content key of each of rows (node, text)."""
    keys, named = classes(rows.select(F.col("node").alias("id"), "text"))
    out = join_by_hash(keys, named, "key", "n", keys.count(), F.col("id"))
    return out.select(F.col("id").alias("node"), F.col("class_id").alias("root"), "key")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id of its class) and kept (it is that one).

    Documents are in one class if a chain of links joins them; two are linked if their counts of 5-word shingles have
    a weighted Jaccard similarity of 0.8 or more. Words are what ASCII white space parts. Texts of equal words are
    copies; a null text is empty, and empty texts are copies. One of fewer than 5 words is one shingle. A row with a
    null doc_id is a document of its own, larger than any other; of a class of such rows alone class_id is null and
    one row is kept. Rows that share a doc_id are one document, in one class. An empty table gives no rows."""
    rows, shift = numbered(plain(docs)[0].select("id", "text"))
    out = decided(rows)
    if shift is None:
        return out.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"), (F.col("node") == F.col("root")).alias("kept"))
    top = rows.filter("id is not null").agg(F.max("node")).first()[0]
    name = lambda c: F.when(F.col(c) <= F.lit(top).cast("long"), F.col(c) + F.lit(shift).cast("long"))
    return out.select(name("node").alias("doc_id"), name("root").alias("class_id"), (F.col("node") == F.col("root")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that near_dedup doesn't keep. Of the rows of a kept doc_id one of each text stays, where
    texts of equal words are the same."""
    base, own = plain(docs)
    rows, _ = numbered(base)
    out = written(decided(rows), "decided")
    gone = written(out.filter("node <> root").select(F.col("node").alias("gone")).distinct(), "gone")
    twice = written(out.filter("node = root").groupBy("node", "key").count().filter("count > 1").select(F.col("node").alias("twice")).distinct(), "twice")
    left = rows.join(gone, F.col("node") == F.col("gone"), "left_anti")
    if not twice.isEmpty():
        words = F.trim(F.regexp_replace("text", r"[\x09-\x0D\x20]+", " "))
        several = left.join(twice, F.col("node") == F.col("twice"), "left_semi").withColumn("same", F.sha2(words, 256)).dropDuplicates(["node", "same"])
        left = left.join(twice, F.col("node") == F.col("twice"), "left_anti").unionByName(several.drop("same"))
    return left.select(*own(left))
