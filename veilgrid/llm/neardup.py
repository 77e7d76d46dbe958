"""Near-duplicate classes by ProbMinHash, banding and exact verification (operator 8).

The weight of a shingle (five words) is its count in the text. Each shingle sends a Poisson process of arrivals of that
rate to random signature slots; a slot keeps its first arrival, and a shingle stops once its next arrival comes after
every slot's. Two signatures agree in a slot with the probability Jaccard similarity of their texts.

Equal texts are one node. Nodes that agree in a band share a bucket. In a bucket every node is compared with three leaders,
never all with all; nodes that this leaves outside their bucket's largest component are then compared with the bucket's
nodes of other components. Small buckets do that pair by pair, crowded ones (over CROWD nodes) block by block with matrix
products. The nodes of huge ones (over HUGE) would be too many pairs of blocks and meet by rare shingles instead: of two texts that reach the threshold, each holds at least that share of its weight in common shingles, so the rarest common
one lies among each text's rarest shingles of just over the other share. Only nodes of different components that meet
there are compared; shingles that many of them hold are worked off in blocks of bounded size with matrix products.
So every pair that shares a bucket is verified, shown to be below the threshold or already connected, and no link between
classes is lost. Similarities are exact. Components are found by star contraction, each round written to the shared folder.

Defined cases: letter case and the kind of white space do not count; a text of one to four words is one shingle; texts
without words equal each other only if their bytes do; null is the empty text; repeated rows share a class; a class's id
is its smallest doc_id (null only if all are null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release_memory, text_key

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
CROWD, BLOCK, HUGE = 32, 400, 6_400
_CHUNK = 1_000_000  # bytes of text looked at together; a longer text is alone
_M = np.uint64(0xFFFFFFFFFFFF)
_random = np.random.default_rng(8)
_LETTER = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), ordered by text, then shingle; shingles are 48-bit hashes. At most 65,536 texts."""
    raws = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begins):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(~space)
    sizes = np.diff(np.append(np.searchsorted(at, begins), len(at)))
    within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = _PLACE[within & 4095]
    if len(sizes) and sizes.max() > 4096:
        place = place * (2 * (within >> 12) + 1).astype(np.uint64)
    word = _mix(np.add.reduceat(_LETTER[raw[at]] * place, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    doc = np.searchsorted(ends, begins, "right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    # a shingle starts at each word that has words-1 after it, or at a short text's first
    left = (first + count)[doc] - np.arange(len(word))
    starts = np.flatnonzero((left >= words) | (np.arange(len(word)) == first[doc]))
    value = np.zeros(len(starts), np.uint64)
    padded = np.append(word, np.zeros(words, np.uint64))
    for k in range(words):
        value += np.where(left[starts] > k, padded[starts + k] * _STEP[k], np.uint64(0))
    value = _mix(value) & _M
    key = np.sort((doc[starts].astype(np.uint64) << np.uint64(48)) | value)
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[fresh] >> np.uint64(48)).astype(np.int64), key[fresh] & _M, np.diff(np.append(fresh, len(key)))


def signatures(n: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, slots: int) -> np.ndarray:
    """uint64 [n, slots]: the shingle whose arrival is first in each slot. Rows without shingles stay 0."""
    best = np.full(n * slots, np.inf)
    sign = np.zeros(n * slots, np.uint64)
    limit = np.full(n, np.inf)
    seed = _mix(shingle + np.uint64(0x9E3779B97F4A7C15))
    clock = np.zeros(len(shingle))
    live, turn = np.arange(len(shingle)), 0
    while len(live):
        turn += 1
        r = _mix(seed[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        clock[live] -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        live = live[clock[live] < limit[doc[live]]]
        if not len(live):
            break
        slot = (_mix(seed[live] ^ np.uint64(turn * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
        at, t = doc[live] * slots + slot, clock[live]
        np.minimum.at(best, at, t)
        won = best[at] == t
        sign[at[won]] = shingle[live[won]]
        docs = np.unique(doc[live]) if len(live) < 50_000 else np.arange(n)
        limit[docs] = best.reshape(n, slots)[docs].max(axis=1)
        live = live[t < limit[doc[live]]]
    return sign.reshape(n, slots)


def similarity(ea: np.ndarray, wa: np.ndarray, eb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements)."""
    if not len(ea) or not len(eb):
        return 0.0
    _, i, j = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    a, b = wa[i].astype(np.float64), wb[j].astype(np.float64)
    only_a, only_b = float(wa.sum() - a.sum()), float(wb.sum() - b.sum())
    order = np.argsort(-(a / b), kind="stable")
    a, b = a[order], b[order]
    ahead, behind = np.cumsum(a), b.sum() - np.cumsum(b)
    # elements of larger ratio count by a, the others by b; equal ratios may count either way
    return float(np.sum(1.0 / ((only_a + ahead) / a + (only_b + behind) / b)))


def _nodes(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """node, key, doc_id (smallest of the text's), bands: one row per distinct text."""

    def run(batches):
        for b in batches:
            for begin, end in _slices(b.column(2), 4096):
                doc, value, count = shingles(b.column(2).slice(begin, end - begin).to_pylist(), words)
                sign = signatures(end - begin, doc, value, count, bands * rows)
                h = np.zeros((end - begin, bands), np.uint64)
                for k in range(rows):
                    h = _mix(h + sign[:, k::rows] * _STEP[k] + np.uint64(k + 1))
                some = np.bincount(doc, minlength=end - begin) > 0
                lists = pa.array([x if ok else None for x, ok in zip(h.view(np.int64).tolist(), some.tolist(), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), b.column(1).slice(begin, end - begin), lists], ["doc_id", "key", "bands"])
        release_memory()

    rows_ = df.select("doc_id", text_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    signed = rows_.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, key string, bands array<long>")
    one = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands", ignorenulls=True).alias("bands"))
    return materialize(one.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _slices(texts: pa.Array, most: int = 256) -> list[tuple[int, int]]:
    """Ranges of rows of at most ``most`` texts and _CHUNK bytes, or of one text."""
    out, begin, size = [], 0, 0
    for k, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if k > begin and (k - begin >= most or size + n > _CHUNK):
            out.append((begin, k))
            begin, size = k, 0
        size += n
    return [*out, (begin, len(texts))] if len(texts) else out


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold, with it."""

    def run(batches):
        last, own = None, None
        for b in batches:
            a_id, b_id, keep, score = b.column(0).to_pylist(), b.column(1).to_pylist(), [], []
            for at, end in _slices(b.column(3)):
                ta, tb = b.column(2).slice(at, end - at).to_pylist(), b.column(3).slice(at, end - at).to_pylist()
                doc, value, count = shingles(tb, words)
                cuts = np.searchsorted(doc, np.arange(len(tb) + 1))
                for k in range(len(tb)):
                    if a_id[at + k] != last:
                        _, *own = shingles([ta[k]], words)
                        last = a_id[at + k]
                    s = similarity(own[0], own[1], value[cuts[k] : cuts[k + 1]], count[cuts[k] : cuts[k + 1]])
                    if s >= threshold - 1e-12:
                        keep.append(at + k)
                        score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array([a_id[k] for k in keep], pa.int64()), pa.array([b_id[k] for k in keep], pa.int64()), pa.array(score, pa.float64())], ["a", "b", "similarity"])
        release_memory()

    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long, similarity double")


def block_links(nodes: list[int], roots: list[int], sides: list[int], texts: list[str], words: int, threshold: float) -> list[tuple[int, int, float]]:
    """Links between nodes of two blocks (sides 0 and 1), or within one, enough to connect what is similar.

    A pair's similarity is at most the weight share that either text has in common shingles: matrix products give that
    for all pairs of the blocks, and the exact similarity is taken where it reaches the threshold and the two are not
    connected yet.
    """
    doc, value, count = shingles(texts, words)
    n = len(texts)
    cuts = np.searchsorted(doc, np.arange(n + 1))
    total = np.bincount(doc, count, minlength=n)
    _, column, often = np.unique(value, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    rank = np.cumsum(often > 1) - 1
    column, rows, weight = rank[column[shared]], doc[shared], (count / total[doc])[shared].astype(np.float32)
    order = np.argsort(column, kind="stable")
    column, rows, weight = column[order], rows[order], weight[order]
    side = np.array(sides)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    common, back = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        w = np.zeros((n, 4096), np.float32)
        w[rows[lo:hi], column[lo:hi] - at] = weight[lo:hi]
        has = (w > 0).astype(np.float32)
        common += w[left] @ has[right].T
        back += has[left] @ w[right].T
    near = np.argwhere(np.minimum(common, back) >= threshold - 1e-4)
    near = near[np.argsort(-np.minimum(common, back)[near[:, 0], near[:, 1]], kind="stable")]
    parent = {r: r for r in roots}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    for i, j in zip(left[near[:, 0]].tolist(), right[near[:, 1]].tolist(), strict=True):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            s = similarity(value[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]], value[cuts[j] : cuts[j + 1]], count[cuts[j] : cuts[j + 1]])
            if s >= threshold - 1e-12:
                parent[max(a, b)] = min(a, b)
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), s))
    return out


def _rare(nodes: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """nodes(node, root, apart) -> value, node, root, lead: who shares rare shingles of the nodes that are ``apart``.

    lead: the value is among the node's rarest shingles, of just over 1 - threshold of its weight; others hold it anywhere.
    Rarity is counted over all these nodes; ties go by the shingle. Only shingles of nodes apart are ranked.
    """

    def run(batches):
        for b in batches:
            for at, end in _slices(b.column(3)):
                doc, value, count = shingles(b.column(3).slice(at, end - at).to_pylist(), words)
                total = np.bincount(doc, count, minlength=end - at)
                rows = pa.array(at + doc)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(3)), pa.array(value.view(np.int64)), pa.array(count / total[doc])], ["node", "root", "apart", "value", "share"])
        release_memory()

    held = nodes.join(texts, "node").select("node", "root", "apart", "text").mapInArrow(run, "node long, root long, apart boolean, value long, share double")
    held = materialize(held, "shingles")
    # a shingle that nodes of one component alone hold can connect nothing
    often = held.groupBy("value").agg(F.count("*").alias("often"), F.min("root").alias("low"), F.max("root").alias("high"))
    order = Window.partitionBy("node").orderBy("often", "value")
    before = F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("share")
    first = held.filter("apart").join(often, "value").withColumn("before", before).filter(F.col("before") <= 1 - threshold + 1e-9)
    first = materialize(first.filter("low <> high").select("value", "node"), "rare-first")
    rows = held.select("value", "node", "root").join(first.select("value").distinct(), "value", "left_semi")
    return rows.join(first.withColumn("lead", F.lit(True)), ["value", "node"], "left").withColumn("lead", F.coalesce("lead", F.lit(False)))


def _crowded(rows: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links among rows(value, node, root) that share a value: each pair of blocks of a value is a task's work."""
    sized = rows.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    n = sized.groupBy("value").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / (_CHUNK // 2)), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.join(n, "value").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root")

    def run(t: pa.Table) -> pa.Table:
        found = block_links(*(t[c].to_pylist() for c in ("node", "root", "side", "text")), words, threshold)
        release_memory()
        return pa.table([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return dealt.join(texts, "node").groupBy("value", "i", "j").applyInArrow(run, "a long, b long, similarity double")


def _apart(rows: DataFrame, key: list[str], main: Column | None = None) -> DataFrame:
    """Pairs a < b of nodes of rows(key, node, root) that share the key but not the root, one of them outside ``main``."""
    x = (rows if main is None else rows.filter(main)).select(*key, F.col("node").alias("x"), F.col("root").alias("x_root"))
    pairs = x.join(rows.select(*key, F.col("node").alias("y"), F.col("root").alias("y_root")), key).filter("x_root <> y_root")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: each node of a link with the smallest node of its component, by star contraction."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(df: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """df(doc_id, text) -> key, class_id, class_key, class_texts: each distinct text's key, its class's smallest (doc_id, key)
    with null doc_ids last, and the class's distinct texts."""
    nodes = _nodes(df, words, bands, rows)
    members = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    # three leaders a bucket: its smallest node, often shared by buckets, and two that differ from bucket to bucket
    drawn = [F.min_by("node", F.xxhash64("node", "band", "value", F.lit(k))).alias(f"l{k}") for k in (1, 2)]
    leaders = members.groupBy("band", "value").agg(F.min("node").alias("l0"), *drawn, F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(members.join(leaders, ["band", "value"]), "buckets")
    pairs = buckets.select("node", F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("leader")).filter("node <> leader")
    near = materialize(pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "pairs")
    # texts of the nodes that are in any bucket; where rows share doc_id and text, one of them
    busy = nodes.select("node", "key", F.col("doc_id").alias("first_id")).join(buckets.select("node").distinct(), "node", "left_semi")
    source = df.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    texts = materialize(source.join(busy, "key").filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", F.coalesce("text", F.lit("")).alias("text")), "texts").dropDuplicates(["node"])
    links = materialize(_verified(near, texts, words, threshold), "links")
    found = components(links)
    # nodes outside the largest component of their bucket meet all of the bucket that is in another one
    root = buckets.select("band", "value", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = root.groupBy("band", "value", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    open_ = sizes.groupBy("band", "value").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).filter("parts > 1")
    # buckets of equal nodes are one
    open_ = open_.groupBy("n", "h1", "h2").agg(F.min(F.struct("band", "value", "main")).alias("b")).select("b.*", "n")
    root = materialize(root.join(open_, ["band", "value"]), "roots")
    few = root.filter(F.col("n") <= CROWD)
    # two buckets of one hash are one larger bucket
    crowded = root.filter((F.col("n") > CROWD) & (F.col("n") <= HUGE)).select(F.xxhash64("band", "value").alias("value"), "node", "root")
    many = root.filter((F.col("n") > CROWD) & (F.col("n") > HUGE)).groupBy("node", "root").agg(F.max(F.col("root") != F.col("main")).alias("apart"))
    rare = materialize(_rare(many, texts, words, threshold), "rare-shingles")
    # a family of texts shares many rare shingles: shingles whose nodes have the same smallest hash are one, twice over
    for seed in (0, 1):
        low = rare.groupBy("value").agg(F.min(F.xxhash64("node", F.lit(seed))).alias("low"))
        rare = rare.join(low, "value").groupBy(F.col("low").alias("value"), "node", "root").agg(F.max("lead").alias("lead"))
    n = rare.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    rare = materialize(rare.join(n.select("value", "n"), "value"), "rare-sets")
    rest = _apart(few, ["band", "value"], F.col("root") != F.col("main")).unionByName(_apart(rare.filter(F.col("n") <= CROWD), ["value"], F.col("lead"))).distinct()
    rest = materialize(rest.join(near, ["a", "b"], "left_anti"), "rest")
    blocks = _crowded(crowded.unionByName(rare.filter(F.col("n") > CROWD).select("value", "node", "root")), texts, words, threshold)
    more = materialize(_verified(rest, texts, words, threshold).unionByName(blocks), "more-links")
    if not more.isEmpty():
        # what is connected already enters as stars
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")))
    named = nodes.select("node", "key", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), first.alias("class_key"), F.count("*").alias("class_texts"))
    return named.join(ids, "root").select("key", "class_id", "class_key", "class_texts")


def near_duplicates(df: DataFrame, **options) -> DataFrame:
    """df(doc_id, text) -> doc_id, class_id, class_texts, one row per input row."""
    found = classes(df, **options)
    return df.select("doc_id", text_key(F.col("text").cast("string")).alias("key")).join(found, "key").select("doc_id", "class_id", "class_texts")
