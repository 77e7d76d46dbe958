"""Approximate nearest neighbours by a forest of random-projection trees (operator 5).

Trees split at the median along the difference of two random points, fitted on a bounded sample; every row is indexed.
A query searches all trees through one shared priority queue ordered by its distance to the nearest side not taken, and
the rows of each visited leaf are reranked exactly. How many leaves that are is measured, not set: the true neighbours of
a bounded set of queries are found by one exact pass over all rows, and the visits are the fewest that reach ``recall`` of
them. Vectors in clusters need few leaves however many rows there are; vectors without structure need many.

Equal vectors are one class with its smallest ids (k + 1 of them answer any query exactly), so copies neither overfill
leaves nor multiply work. A leaf that outgrows ``leaf_rows`` because the sample is bounded is dealt to slices, and the
queries to blocks, so a task holds a bounded part of both. A task takes a group of neighbouring leaves, and a query sends
k + 1 candidates for each to its final ranking.

Defined cases: null, zero or non-finite vectors, and those of another length than most, take no part, nor do null ids;
fewer than k other rows: all of them; ties: smaller vec_id; an empty table: no rows; columns other than vec_id, embedding
and those of ``query`` are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FIT_ROWS, TREES, LEAF_ROWS, RECALL = 20_000, 8, 200, 0.95
#: Queries whose true neighbours set the visits; most queries of a group of leaves in one task.
PROBES, BLOCK_QUERIES = 128, 20_000
#: Neighbouring leaves of a tree that one task reranks together: a query sends k + 1 candidates for all of them.
GROUP_LEAVES = 64


class Tree:
    """Hyperplanes in preorder arrays; a negative child -1-j is leaf j."""

    def __init__(self, unit: np.ndarray, leaves: int, rng: np.random.Generator):
        self.planes, self.cuts, self.kids, self.leaves = [], [], [], 0
        self.root = self._grow(unit, np.arange(len(unit)), leaves, rng)
        self.planes, self.cuts, self.kids = np.array(self.planes).reshape(-1, unit.shape[1]), np.array(self.cuts), np.array(self.kids, np.int64).reshape(-1, 2)

    def _grow(self, unit: np.ndarray, rows: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves >= 2 and len(rows) >= 4:
            a, b = unit[rng.choice(rows, 2, replace=False)]
            side = unit[rows] @ (a - b)
            cut = float(np.median(side))
            low = side <= cut
            if 0 < low.sum() < len(rows):
                k = len(self.planes)
                self.planes.append(a - b)
                self.cuts.append(cut)
                self.kids.append([0, 0])
                self.kids[k] = [self._grow(unit, rows[low], leaves // 2, rng), self._grow(unit, rows[~low], leaves - leaves // 2, rng)]
                return k
        self.leaves += 1
        return -self.leaves

    def route(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(unit), self.root, np.int64)
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            low = np.einsum("ij,ij->i", unit[live], self.planes[node]) <= self.cuts[node]
            at[live] = self.kids[node, np.where(low, 0, 1)]
            live = live[at[live] >= 0]
        return -1 - at


class Forest:
    def __init__(self, unit: np.ndarray, leaves: int, trees: int, seed: int = 5):
        self.trees = [Tree(unit, leaves, np.random.default_rng([seed, t])) for t in range(trees)]

    def search(self, q: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in order of the shared queue."""
        sides = [t.planes @ q - t.cuts if len(t.cuts) else np.empty(0) for t in self.trees]
        queue = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
        out = []
        while queue and len(out) < visits:
            far, k, node = heapq.heappop(queue)
            while node >= 0:
                s = sides[k][node]
                near = 0 if s <= 0 else 1
                heapq.heappush(queue, (max(far, abs(s)), k, int(self.trees[k].kids[node, 1 - near])))
                node = int(self.trees[k].kids[node, near])
            out.append((k, -1 - node))
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, own: np.ndarray, most: int):
    """(query position, candidate position, exact cosine) of the best ``most`` candidates of each query."""
    scores = _unit(q) @ _unit(c).T
    most = min(most, len(cid))
    # ties at the cut go to the smaller class id: candidates come in its order and the sort is stable
    top = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :most]
    i, j = np.repeat(np.arange(len(q)), most), top.ravel()
    a, b = q[i], c[j]
    return i, j, (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _true_neighbours(classes: DataFrame, probes: np.ndarray, k: int) -> dict[int, list[list[float]]]:
    """Probe number -> vectors of its k nearest in other directions, by one pass over all rows."""
    q, dim = _unit(probes), probes.shape[1]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                scores = q @ _unit(_matrix(some.column(1), dim)).T
                scores[scores > 1 - 1e-12] = -np.inf
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                rows, cols = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(scores[rows, cols]), some.column(0).take(pa.array(cols)), some.column(1).take(pa.array(cols))], ["probe", "score", "cls", "embedding"])

    found = classes.select("cls", "embedding").mapInArrow(run, "probe long, score double, cls long, embedding array<float>")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "cls")
    out: dict[int, list[list[float]]] = {}
    for r in found.withColumn("r", F.row_number().over(order)).filter((F.col("r") <= k) & (F.col("score") >= -1.1)).collect():
        out.setdefault(r.probe, []).append(r.embedding)
    return out


def visits_for(forest: Forest, probes: np.ndarray, near: dict[int, list[list[float]]], recall: float) -> int:
    """The fewest leaves to visit that find ``recall`` of the probes' true neighbours; at least one a tree."""
    turns = []
    for k, vectors in near.items():
        unit = _unit(np.array(vectors, np.float64))
        place = {pair: turn for turn, pair in enumerate(forest.search(probes[k], sum(t.leaves for t in forest.trees)), 1)}
        leaves = [tree.route(unit) for tree in forest.trees]
        turns += [min(place[t, int(leaves[t][j])] for t in range(len(leaves))) for j in range(len(unit))]
    turns.sort()
    return max(len(forest.trees), turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)] if turns else 0)


def neighbours(df: DataFrame, k: int = 5, *, query, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """df(vec_id, embedding) -> query_id, rank, vec_id, score for the rows where the column ``query`` holds."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.filter(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = length.n if length else 1
    rows = rows.filter(F.size("embedding") == dim)
    # equal vectors: the k + 1 smallest ids; the rank filter also limits each group before the shuffle
    first = Window.partitionBy("embedding").orderBy("vec_id")
    classes = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("members"))
    classes = materialize(classes.withColumn("cls", F.element_at("members", 1)), "vector-classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(fit_rows).select("embedding").toArrow()["embedding"].combine_chunks()
    leaves = max(1, min(n // leaf_rows, len(sample) // 8))
    forest = Forest(_unit(_matrix(sample, dim)) if len(sample) else np.ones((1, dim)), leaves, trees)
    queries = rows.filter(query).dropDuplicates(["vec_id"])
    probes = _matrix(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).select("embedding").toArrow()["embedding"].combine_chunks(), dim) if leaves > 1 else np.empty((0, dim))
    near = _true_neighbours(classes, probes, k) if len(probes) else {}
    visits = visits_for(forest, _unit(probes), near, recall)
    slices = max(1, -(-n // (leaves * leaf_rows * 2)))
    shared = df.sparkSession.sparkContext.broadcast(forest)  # at most fit_rows / 8 hyperplanes a tree

    def route(batches):
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column(1), dim))
                for t, tree in enumerate(shared.value.trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(tree.route(unit).astype(np.int32)), b.column(0), b.column(1)], ["tree", "leaf", "cls", "embedding"])

    def probe(batches):
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column(1), dim)
                for at in range(0, len(q), 200):
                    who, tree, group, held = [], [], [], []
                    for k, u in enumerate(_unit(q[at : at + 200]), at):
                        own: dict[tuple[int, int], list[int]] = {}
                        for t, leaf in shared.value.search(u, visits):
                            own.setdefault((t, leaf // GROUP_LEAVES), []).append(leaf)
                        for (t, g), leaves_ in own.items():
                            who.append(k), tree.append(t), group.append(g), held.append(leaves_)
                    rows_ = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(group, pa.int32()), b.column(0).take(rows_), b.column(1).take(rows_), pa.array(held, pa.list_(pa.int32()))], ["tree", "group", "query_id", "embedding", "leaves"])

    # queries of a group on average, in blocks; a group's rows go to each block
    n_groups = trees * -(-leaves // GROUP_LEAVES)
    blocks = max(1, -(-queries.count() * min(visits, n_groups) // (n_groups * BLOCK_QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    placed = classes.select("cls", "embedding").mapInArrow(route, "tree int, leaf int, cls long, embedding array<float>").withColumn("group", F.floor(F.col("leaf") / GROUP_LEAVES).cast("int"))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("cls"), F.lit(slices))).withColumn("block", every(blocks))
    asked = queries.mapInArrow(probe, "tree int, group int, query_id long, embedding array<float>, leaves array<int>").withColumn("slice", every(slices)).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "cls", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        left, right = left.combine_chunks(), right.sort_by([("leaf", "ascending"), ("cls", "ascending")]).combine_chunks()
        cid, leaf = right["cls"].to_numpy(), right["leaf"].to_numpy()
        q, c = _matrix(left["embedding"].combine_chunks(), dim), _matrix(right["embedding"].combine_chunks(), dim)
        visited = left["leaves"].combine_chunks()
        asks, wanted = np.repeat(np.arange(len(q)), np.diff(visited.offsets.to_numpy())), visited.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        asks, wanted = asks[order], wanted[order]
        parts = []
        for one in np.unique(wanted).tolist():
            who = asks[slice(*np.searchsorted(wanted, [one, one + 1]))]
            lo, hi = np.searchsorted(leaf, [one, one + 1])
            for at in range(0, len(who) if hi > lo else 0, 1000):
                some = who[at : at + 1000]
                i, j, s = _best(some, q[some], cid[lo:hi], c[lo:hi], cid, k + 1)
                parts.append((some[i], cid[lo:hi][j], s))
        if not parts:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        who, near, score = (np.concatenate([p[m] for p in parts]) for m in range(3))
        order = np.lexsort((near, -np.round(score, 12), who))
        who, near, score = who[order], near[order], score[order]
        first = np.concatenate([[True], who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
        top = rank <= k
        return pa.table([pa.array(left["query_id"].to_numpy()[who[top]]), pa.array(near[top]), pa.array(score[top])], names=names)

    keys = ["tree", "group", "slice", "block"]
    found = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(rerank, "query_id long, cls long, score double")
    found = found.groupBy("query_id", "cls").agg(F.max("score").alias("score"))
    found = found.join(classes.select("cls", "members"), "cls").select("query_id", "score", F.explode("members").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
