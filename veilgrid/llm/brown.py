"""Scores of a Brown class-based bigram model (operator 10).

Words are counted over all training texts. Every word met ``least`` times or more is a unit of its own, however many
there are; rarer words, which have next to no context, belong to the unit of their ending. Exchange clustering moves
units between classes while the class-bigram likelihood of the training texts grows: first one at a time over the
``most`` most frequent words and the endings, which gives every word a class to start from, then over all units in
rounds. A round sums each unit's neighbours by class in Spark and moves units by the change of likelihood; the
likelihood is then counted anew, and a round that did not raise it is undone. A token's probability is that of its class
after the class before it, times that of the word in its class; both are smoothed, and an unseen word has the mass of
one more word in its class.

Texts are read twice (count words, write units); the rounds and the scores read the units. Each task holds the table of
units (12 bytes a word) and its classes; the driver holds these, a matrix of (most + endings) squared and one of classes
squared. Counts of rarer words are joined by word.

Defined cases: null is the empty text, which is one end token; a null doc_id counts as the empty text for the split; no
training rows: all counts are 0; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UNITS, ENDINGS, CLASSES, HEAD, ROUNDS, BACKOFF = 600, 128, 48, 100_000, 12, 5.0
#: Words met less often are units by ending. A round that adds less than RISE nats a token is the last.
LEAST, RISE, CHUNK = 5, 1e-3, 2_000_000
#: Units whose moves one task chooses: their counts by class are at most 2 x classes a unit.
BUCKET_UNITS = 8_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = b"\n"  # white space, so never a word


def words(text: str | None) -> list[bytes]:
    """UTF-8 words: A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def ending(word: bytes, endings: int = ENDINGS) -> int:
    return zlib.crc32(word[-3:]) % endings


def word_counts(df: DataFrame) -> DataFrame:
    """df(text) -> word binary, c: summed per task, then by word; each text adds one end token."""

    def flush(c: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                c.update(words(t.as_py()))
                c[END] += 1
                if len(c) > 400_000:
                    yield flush(c)
                    c = Counter()
        if c:
            yield flush(c)

    return df.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_id(word: bytes) -> int:
    """60 bits of a word's MD5; the same as ``_word_id`` of a column."""
    return int.from_bytes(hashlib.md5(word).digest()[:8], "big") >> 4


def _word_id(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


class Units:
    """word -> unit. Unit 0 is the end; words by falling count follow, then endings. ``head``: the first words themselves."""

    def __init__(self, head: list[bytes], ids: np.ndarray, counts: np.ndarray, endings: int):
        self.endings = endings
        self.first_ending = 1 + len(ids)
        self.size = self.first_ending + endings
        self.head = {w: 1 + k for k, w in enumerate(head)}
        order = np.argsort(ids, kind="stable")
        self.ids, self.unit_of = ids[order], (order + 1).astype(np.int32)
        #: log10(count + 1) of the words' units
        self.log = np.log10(np.concatenate([[0], counts]) + 1)

    def of(self, own: list[bytes]) -> np.ndarray:
        found = np.array([self.head.get(w, 0) for w in own], np.int32)
        rest = np.flatnonzero(found == 0)
        if len(rest):
            other = [own[k] for k in rest.tolist()]
            at = np.zeros(len(rest), np.int64)
            same = np.zeros(len(rest), bool)
            if len(self.ids):
                ids = np.array([word_id(w) for w in other], np.int64)
                at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
                same = self.ids[at] == ids
            end = np.array([self.first_ending + zlib.crc32(w[-3:]) % self.endings for w in other], np.int32)
            found[rest] = np.where(same, self.unit_of[at], end) if len(self.ids) else end
        return found


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts of a batch, and where each text starts; each ends with unit 0."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] // 4
    return np.frombuffer(col.buffers()[2], np.int32)[at[0] : at[-1]], at[:-1] - at[0]


def _chunks(batches):
    """Units of many texts at a time."""
    held: list[np.ndarray] = []
    for b in batches:
        if b.num_rows:
            held.append(_flat(b.column(0))[0])
        if sum(map(len, held)) > CHUNK:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def pair_counts(seqs: DataFrame, label, size: int) -> np.ndarray:
    """seqs(units) -> how often each label follows each; ``label`` is a broadcast array by unit."""

    def run(batches):
        of = label.value
        total = np.zeros(size * size, np.int64)
        for u in _chunks(batches):
            c = of[u].astype(np.int64)
            total += np.bincount(np.concatenate([of[:1], c[:-1]]) * size + c, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((used // size).astype(np.int32)), pa.array((used % size).astype(np.int32)), pa.array(total[used])], ["a", "b", "n"])

    found = seqs.select("units").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size))
    out[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def _xlogx(x):
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """What the classes decide of the training texts' log likelihood, from counts of class pairs."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=1)).sum() - _xlogx(m.sum(axis=0)).sum())


def propose(unit: np.ndarray, k: np.ndarray, n: np.ndarray, cls: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that are better off in another class, and that class, from counts n of (unit, k).

    k is the class before the unit, or ``classes`` + the class after it.
    """
    size = len(m)
    key, inverse = np.unique(unit.astype(np.int64) * (2 * size) + k, return_inverse=True)
    n = np.bincount(inverse, n, len(key))
    unit, k = key // (2 * size), key % (2 * size)
    cells, rows, cols = np.concatenate([m, m.T]), m.sum(axis=1), m.sum(axis=0)
    own, start = np.unique(unit, return_index=True)
    bounds = np.append(start, len(unit))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(own), 500):
        some, lo, hi = own[at : at + 500], bounds[at], bounds[min(at + 500, len(own))]
        first, a, x, nk = start[at : at + 500] - lo, cls[some], n[lo:hi], k[lo:hi]
        base = cells[nk]
        base[np.arange(hi - lo), cls[unit[lo:hi]]] -= x  # without the unit itself
        gain = np.add.reduceat(_xlogx(base + x[:, None]) - _xlogx(base), first, axis=0)
        for whole, side in ((rows, nk >= size), (cols, nk < size)):
            t = np.add.reduceat(x * side, first)
            rest = np.repeat(whole[None], len(some), axis=0)
            rest[np.arange(len(some)), a] -= t
            gain -= _xlogx(rest + t[:, None]) - _xlogx(rest)
        gain[:, 0] = -np.inf
        to = np.argmax(gain, axis=1)
        every = np.arange(len(some))
        better = gain[every, to] > gain[every, a] + 1e-9
        found.append((some[better], to[better]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def pack_counts(key: np.ndarray, n: np.ndarray) -> bytes:
    """Rising keys with counts, as the keys' steps and the counts side by side, compressed."""
    steps = np.diff(key, prepend=0).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), np.uint8)
    half = len(both) // 2
    steps, n = (np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel() for x in (both[:half], both[half:]))
    return np.cumsum(steps, dtype=np.int64), n.astype(np.int64)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of several lists."""
    key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)


def moves(seqs: DataFrame, state, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """seqs(units) -> ``propose`` over all units; ``state`` is a broadcast (class of each unit, counts of class pairs).

    A task sums its counts of (unit, neighbour's class) and sends each bucket of units one packed list of them.
    """

    def contexts(batches):
        cls = state.value[0]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            key, n = merge_counts(held) if len(held) > 1 else held[0]
            w, k = key // (2 * size), key % (2 * size)
            bucket, local = w % buckets, (w // buckets) * (2 * size) + k
            order = np.argsort(bucket, kind="stable")  # keys rise within a bucket
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            local, n = local[order], n[order]
            used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            packed = [pack_counts(local[cuts[b] : cuts[b + 1]], n[cuts[b] : cuts[b + 1]]) for b in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "counts"])

        for u in _chunks(batches):
            c = cls[u].astype(np.int64)
            before, after = np.concatenate([[0], c[:-1]]), np.concatenate([c[1:], [0]])
            w = u.astype(np.int64) * (2 * size)
            inner = u > 0
            held.append(np.unique(np.concatenate([(w + before)[inner], (w + size + after)[inner]]), return_counts=True))
            if sum(len(x[0]) for x in held) > 4 * CHUNK:
                yield flush()
                held = []
        if held and sum(len(x[0]) for x in held):
            yield flush()

    def choose(t: pa.Table) -> pa.Table:
        cls, m = state.value
        bucket = t["bucket"][0].as_py()
        key, n = merge_counts([unpack_counts(x) for x in t["counts"].to_pylist()])
        unit, to = propose((key // (2 * size)) * buckets + bucket, key % (2 * size), n, cls, m)
        return pa.table([pa.array(unit.astype(np.int32)), pa.array(to.astype(np.int32))], names=["unit", "to"])

    found = seqs.select("units").mapInArrow(contexts, "bucket int, counts binary").groupBy("bucket").applyInArrow(choose, "unit int, to int").toArrow()
    return found["unit"].to_numpy(), found["to"].to_numpy()


def exchange_all(seqs: DataFrame, cls: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all units from given ones on, their pair counts, and the likelihood after each round that raised it."""
    context = seqs.sparkSession.sparkContext
    best, best_m, trace = cls, None, []
    for _ in range(rounds + 1):
        m = pair_counts(seqs, context.broadcast(cls), size)
        now = likelihood(m)
        if trace and now <= trace[-1]:
            break
        small = bool(trace) and now - trace[-1] < RISE * m.sum()
        best, best_m, _ = cls, m, trace.append(now)
        if small or len(trace) > rounds:
            break
        unit, to = moves(seqs, context.broadcast((cls, m)), size, -(-len(cls) // BUCKET_UNITS))
        if not len(unit):
            break
        cls = cls.copy()
        cls[unit] = to
    return best, best_m, trace


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: each in turn moves to the class that raises the likelihood most, until none moves.

    Unit 0 (the end) keeps class 0 for itself.
    """

    n = len(pairs)
    classes = max(2, min(classes, n))
    weight = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-weight[1:], kind="stable") + 1
    cls = np.zeros(n, np.int64)
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    one = np.eye(classes)[cls]
    left, right = pairs.T @ one, pairs @ one  # per unit: what precedes and what follows it, by class
    m = one.T @ right
    rest = np.arange(1, classes)
    for _ in range(rounds):
        moved = 0
        for w in order[weight[order] > 0].tolist():
            a, self_n = cls[w], pairs[w, w]
            lw, rw = left[w].copy(), right[w].copy()
            lw[a] -= self_n
            rw[a] -= self_n
            m[:, a] -= lw
            m[a, :] -= rw
            m[a, a] -= self_n
            rows, cols = m.sum(axis=1), m.sum(axis=0)
            gain_r = _xlogx(m + rw) - _xlogx(m)  # row b gets rw
            gain_l = _xlogx(m + lw[:, None]) - _xlogx(m)  # column b gets lw
            d = np.diag(m)
            gain = gain_r.sum(axis=1) - np.diag(gain_r) + gain_l.sum(axis=0) - np.diag(gain_l) + _xlogx(d + lw + rw + self_n) - _xlogx(d)
            tw_r, tw_l = rw.sum() + self_n, lw.sum() + self_n
            gain -= _xlogx(rows + tw_r) - _xlogx(rows) + _xlogx(cols + tw_l) - _xlogx(cols)
            b = int(rest[np.argmax(gain[rest])])
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            m[:, b] += lw
            m[b, :] += rw
            m[b, b] += self_n
            if b != a:
                moved += 1
                cls[w] = b
                # neighbours see w in another class
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return cls


class Model:
    """Log10 tables: ``step[a, b]`` of classes; ``room[class]`` = log10 of the class's tokens + words + 1."""

    def __init__(self, cls: np.ndarray, m: np.ndarray, kinds: np.ndarray):
        size = len(m)
        tokens = m.sum(axis=0)
        prior = (tokens + 1) / (tokens.sum() + size)
        self.step = np.log10((m + BACKOFF * prior) / (m.sum(axis=1, keepdims=True) + BACKOFF))
        self.room = np.log10(tokens + np.bincount(cls, kinds, size) + 1)
        self.room[0] = 0.0
        self.cls = cls


def _ending(word: Column, endings: int) -> Column:
    return F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(endings)).cast("int")


def collect_units(counts: DataFrame, least: int, endings: int, head: int) -> tuple[Units, np.ndarray, np.ndarray]:
    """counts(word, c) -> units, the ending of each word that is a unit, distinct words of each unit."""
    plain = counts.filter(F.col("word") != F.lit(END))
    often = plain.filter(F.col("c") >= least).orderBy(F.desc("c"), "word")
    top = often.select(_word_id(F.col("word")).alias("id"), "c", _ending(F.col("word"), endings).alias("e")).toArrow()
    units = Units(often.limit(head).select("word").toArrow()["word"].to_pylist(), top["id"].to_numpy(), top["c"].to_numpy(), endings)
    kinds = np.zeros(units.size)
    kinds[1 : units.first_ending] = 1
    for r in plain.filter(F.col("c") < least).groupBy(_ending(F.col("word"), endings).alias("e")).count().collect():
        kinds[units.first_ending + r.e] = r["count"]
    return units, top["e"].to_numpy(), kinds


def encode(rows: DataFrame, units: Units, end_known: bool) -> DataFrame:
    """rows(doc_id, text, train) -> doc_id, train, row, n_tokens, known, logs, units (int32s), and rarer words and their times."""
    shared = rows.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        u = shared.value
        names = ["doc_id", "train", "n_tokens", "known", "logs", "units", "words", "times"]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                texts = [words(t.as_py()) for t in some.column(1)]
                found = u.of([w for own in texts for w in own])
                cols: list[list] = [[] for _ in kinds]
                end = 0
                for own in texts:
                    unit = found[end : end + len(own)]
                    end += len(own)
                    often = unit < u.first_ending
                    tail = Counter([own[k] for k in np.flatnonzero(~often).tolist()])
                    for col, x in zip(cols, (len(own) + 1, int(often.sum()) + end_known, float(u.log[unit[often]].sum()), np.append(unit, np.int32(0)).tobytes(), list(tail), list(tail.values())), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = dict(rows.dtypes)["doc_id"]
    parts = rows.select("doc_id", "text", "train").mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, known long, logs double, units binary, words array<binary>, times array<long>")
    return materialize(parts.withColumn("row", F.monotonically_increasing_id()), "score-parts")


def cluster(seqs: DataFrame, units: Units, ends: np.ndarray, most: int, classes: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """seqs(units) of the training texts -> as ``exchange_all``; it starts from exchange over frequent words and endings."""
    most = min(most, units.first_ending - 1)
    coarse = np.concatenate([np.arange(most + 1), 1 + most + ends[most:], 1 + most + np.arange(units.endings)])
    first = exchange(pair_counts(seqs, seqs.sparkSession.sparkContext.broadcast(coarse), 1 + most + units.endings), classes)
    return exchange_all(seqs, first[coarse], int(first.max()) + 1)


def score(df: DataFrame, training: Column, most: int = UNITS, endings: int = ENDINGS, classes: int = CLASSES, head: int = HEAD, least: int = LEAST) -> DataFrame:
    """df(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score, one row per input row."""
    rows = df.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("train", F.coalesce(training, F.lit(False)))
    counts = materialize(word_counts(rows.filter("train").select("text")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end_count = counts.filter(F.col("word") == F.lit(END)).first()
    units, ends, kinds = collect_units(counts, least, endings, head)
    parts = encode(rows, units, end_count is not None)
    cls, m, _ = cluster(parts.filter("train").select("units"), units, ends, most, classes)
    shared = df.sparkSession.sparkContext.broadcast(Model(cls, m, kinds))

    def run(batches):
        model = shared.value
        for b in batches:
            if b.num_rows:
                u, start = _flat(b.column(1))
                c = model.cls[u]
                before = np.concatenate([[0], c[:-1]])
                total = np.add.reduceat(model.step[before, c] - model.room[c], start)
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(total)], ["row", "doc_id", "n_tokens", "known", "logs", "model"])

    kind = dict(df.dtypes)["doc_id"]
    scored = parts.select("row", "units", "doc_id", "n_tokens", "known", "logs").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, logs double, model double")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times").withColumnRenamed("words", "word")
    known = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    out = scored.join(known, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    end = float(np.log10((end_count.c if end_count else 0) + 1))
    room = float(np.log10(n + 1 * (v + 1)))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * room).alias("base_score"), (logs + F.col("model")).alias("score"),
    )
