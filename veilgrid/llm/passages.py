"""Exact repeated-passage removal with suffix arrays (operator 6).

A byte is removed if a ``span``-byte string that covers it also starts anywhere else, in another or the same text.

1. Anchors. Each span-byte window belongs to its gram (a fifth of the span) of smallest hash (the leftmost, where several tie), so equal windows
   belong to equal grams at the same offset. An anchor is such a gram with its run of windows; their union is its context.
2. Only anchors met at two or more places go on, and of equal contexts one, with its multiplicity. A context met twice
   is covered whole.
3. Contexts are dealt to shards by anchor. In a shard they are cut into pieces of BLOCK windows. A piece whose core (what
   all its windows share) no other piece has cannot repeat; equal pieces are one. Of the rest each shard builds one suffix
   array by induced sorting, and permuted common prefixes; runs of common prefixes of span or more are repeated strings.
4. An anchor whose distinct contexts are too many for one shard is not capped: its pieces, and then the windows of those
   pieces that stay open, are counted by 128-bit hashes in shuffles with map-side sums instead.
5. Covered stretches go back to every occurrence of their context, are merged per text, and cut out.

Texts are keyed by a 128-bit digest, so equal rows and null or repeated doc_ids need no special care: equal texts are
further occurrences. Only bounded things meet in a task: a shard, or one text.

Defined cases: null is the empty text; texts under ``span`` bytes keep all; extra columns are kept where asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory
from .suffix import permuted_common_prefixes, suffix_array

BLOCK, SHARD_BYTES, ANCHOR_BYTES, SORT_BYTES = 32, 1_500_000, 1_000_000, 700_000
_LONG = 8_000_000
_CTX = ["fp", "c1", "c2", "size"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Hashes of any substrings of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, seed: int, base: int):
        self.letters = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        for name, b in (("up", self.base), ("down", self.inverse)):
            p = getattr(self, name)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            setattr(self, name, p)

    def load(self, raw: np.ndarray) -> _Rolling:
        self._powers(len(raw) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.letters[raw] * self.up[: len(raw)], dtype=np.uint64)])
        return self

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _slide_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % w, v[-1])]).reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def owners(values: np.ndarray, w: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of usable windows with the same smallest value.

    values: 40-bit hashes; positions fit 24 bits.
    """
    low = _slide_min((values << np.uint64(24)) | np.arange(len(values), dtype=np.uint64), w)
    owner = np.where(usable, (low & np.uint64(0xFFFFFF)).astype(np.int64), -1)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(first[1:], len(owner)) - 1
    real = owner[first] >= 0
    return owner[first][real], first[real], last[real]


def _anchors(df: DataFrame, span: int) -> DataFrame:
    """df(text) -> k1, k2 (text key), pos, fp, c1, c2, left, size: a row for each anchor of each text."""

    gram = max(1, span // 5)

    def run(batches):
        one, two = _Rolling(1, 0x9E3779B97F4A7C15), _Rolling(2, 0xC2B2AE3D27D4EB4F)
        names = ["k1", "k2", "pos", "fp", "c1", "c2", "left", "size"]

        def emit(raws, key=None, shift=0):
            sizes = np.array([len(r) for r in raws])
            raw = np.frombuffer(b"".join(raws), np.uint8)
            ends = np.cumsum(sizes)
            keys = np.frombuffer(key or b"".join(hashlib.md5(r).digest() for r in raws), "<i8").reshape(-1, 2)
            one.load(raw), two.load(raw)
            at = np.arange(len(raw) - gram + 1)
            value = one.of(at, at + gram)
            usable = np.ones(len(raw) - span + 1, bool)  # windows that lie in one text
            for e in ends[:-1].tolist():
                usable[e - span + 1 : e] = False
            p, begin, last = owners(value >> np.uint64(24), span - gram + 1, usable)
            end = last + span
            doc = np.searchsorted(ends, p, "right")
            left, size = (p - begin).astype(np.int32), (end - begin).astype(np.int32)
            c1 = one.of(begin, end) ^ _mix(left.astype(np.uint64) + np.uint64(7))
            c2 = two.of(begin, end) ^ _mix(size.astype(np.uint64) + np.uint64(77))
            pos = p - (ends[doc] - sizes[doc]) + shift
            cols = [keys[doc, 0], keys[doc, 1], pos, value[p].view(np.int64), c1.view(np.int64), c2.view(np.int64), left, size]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names)

        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                raw = t.encode() if t else b""
                if len(raw) > _LONG:  # a run cut between chunks is two anchors with part of the windows each
                    key = hashlib.md5(raw).digest()
                    for k in range(0, len(raw) - span + 1, _LONG):
                        yield emit([raw[k : k + _LONG + span - 1]], key, k)
                elif len(raw) >= span:
                    held.append(raw)
                    size += len(raw)
                    if size >= 500_000:
                        yield emit(held)
                        held, size = [], 0
        if held:
            yield emit(held)
        release_memory()

    return df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k1 long, k2 long, pos long, fp long, c1 long, c2 long, left int, size int")


def covered(contexts: list[bytes], counts: np.ndarray, places: list[tuple], span: int) -> list[list[tuple[int, int]]]:
    """Stretches of each context covered by a span-byte string that starts at two or more places.

    counts: how often each context occurs; places: (text, position) of one occurrence's first byte.
    """
    sizes = np.array([len(c) for c in contexts])
    parts = np.zeros(int(sizes.sum()) + len(contexts) + 1, np.uint16)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(len(parts), bool)
    inside[begins + sizes] = False
    inside[-1] = False
    parts[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    parts[inside] += 2
    parts[begins + sizes] = 1  # separators; the final 0 is the text's end
    sa = suffix_array(parts)
    plcp = permuted_common_prefixes(parts, sa, span)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    owner = np.append(owner, len(contexts) - 1)
    whole = np.append(begins + sizes, len(parts))[owner] - np.arange(len(parts)) >= span
    whole[-1] = False
    # runs in suffix order whose members share span bytes
    keep = whole[sa]
    joined = np.concatenate([[False], (plcp[sa[1:]] >= span) & keep[1:] & keep[:-1]])
    group = np.cumsum(~joined) - 1
    member = np.flatnonzero(keep)
    at, g = sa[member].astype(np.int64), group[member]
    many = counts[owner[at]] > 1
    texts: dict = {}
    text_no = np.array([texts.setdefault(p[0], len(texts)) for p in places], np.int64)
    start = np.array([p[1] for p in places], np.int64)
    absolute = (text_no[owner[at]] << 40) + start[owner[at]] + (at - begins[owner[at]])
    order = np.argsort(g, kind="stable")
    at, g, many, absolute = at[order], g[order], many[order], absolute[order]
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if not len(at):
        return out
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    repeated = (np.minimum.reduceat(absolute, head) != np.maximum.reduceat(absolute, head)) | np.logical_or.reduceat(many, head)
    hits = np.sort(at[np.repeat(repeated, np.diff(np.append(head, len(at))))])
    if not len(hits):
        return out
    fresh = np.concatenate([[True], (hits[1:] - hits[:-1] > span) | (owner[hits[1:]] != owner[hits[:-1]])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(hits)) - 1
    for a, b in zip(hits[first].tolist(), hits[last].tolist(), strict=True):
        k = int(owner[a])
        out[k].append((a - int(begins[k]), b - int(begins[k]) + span))
    return out


class _Pieces:
    """Contexts of known anchors cut into aligned pieces of ``block`` windows, with hashes of their hulls and cores."""

    def __init__(self, raws: list[bytes], lefts: np.ndarray, fps: np.ndarray, span: int, block: int):
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        buffer = np.frombuffer(b"".join(raws), np.uint8)
        one, two = _Rolling(3, 0x9E3779B97F4A7C15).load(buffer), _Rolling(4, 0xC2B2AE3D27D4EB4F).load(buffer)
        # offsets of windows from the anchor run from left down to left - windows + 1
        most = np.asarray(lefts, np.int64)
        least = most - (self.sizes - span)
        count = most // block - least // block + 1
        self.ctx = np.repeat(np.arange(len(raws)), count)
        k = most[self.ctx] // block - (np.arange(len(self.ctx)) - np.repeat(np.cumsum(count) - count, count))
        top, low = np.minimum(most[self.ctx], k * block + block - 1), np.maximum(least[self.ctx], k * block)
        anchor = self.begins[self.ctx] + most[self.ctx]
        self.lo, self.hi = most[self.ctx] - top, most[self.ctx] - low + span  # the hull in its context
        at, to = anchor - top, anchor - low + span
        salt = _mix(k.astype(np.uint64) + np.uint64(11)) ^ np.asarray(fps, np.int64)[self.ctx].view(np.uint64)
        self.core = one.of(anchor - k * block, anchor - (k * block + block - 1) + span) ^ salt
        shape = _mix(((most[self.ctx] - top - most[self.ctx]) & 0xFFFF).astype(np.uint64) << np.uint64(16) | (to - at).astype(np.uint64))
        self.h1, self.h2 = one.of(at, to) ^ salt ^ shape, two.of(at, to) ^ _mix(salt)


def covered_contexts(raws: list[bytes], lefts: np.ndarray, fps: np.ndarray, counts: np.ndarray, places: list[tuple], span: int) -> list[tuple[int, int, int]]:
    """(context, begin, end) of covered stretches of the distinct contexts of a shard."""
    if not raws:
        return []
    p = _Pieces(raws, lefts, fps, span, BLOCK)
    _, first, hull = np.unique(np.stack([p.h1, p.h2], axis=1), axis=0, return_index=True, return_inverse=True)
    hull = hull.ravel()
    times = np.bincount(hull, counts[p.ctx]).astype(np.int64)
    _, group = np.unique(p.core[first], return_inverse=True)
    kinds = np.bincount(group)[group]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(first))]
    for h in np.flatnonzero(times > 1).tolist():
        out[h].append((0, int(p.hi[first[h]] - p.lo[first[h]])))
    # pieces that share their core with another one are told apart by the suffix array
    rest = np.flatnonzero(kinds > 1)
    at = first[rest]
    texts = [raws[c][a:b] for c, a, b in zip(p.ctx[at].tolist(), p.lo[at].tolist(), p.hi[at].tolist(), strict=True)]
    where = [(places[c][0], places[c][1] + a) for c, a in zip(p.ctx[at].tolist(), p.lo[at].tolist(), strict=True)]
    begin = 0
    order = np.argsort(group[rest], kind="stable")  # pieces of one core stay in one suffix array
    sizes = np.array([len(texts[k]) for k in order])
    ends = np.cumsum(sizes)
    borders = np.flatnonzero(np.concatenate([group[rest][order][1:] != group[rest][order][:-1], [True]])) if len(order) else []
    start = 0
    for stop in borders:
        if ends[stop] - begin < SORT_BYTES and stop != borders[-1]:
            continue
        own = order[start : stop + 1].tolist()
        for k, found in zip(own, covered([texts[k] for k in own], times[rest[own]], [where[k] for k in own], span), strict=True):
            out[int(rest[k])] += found
        start, begin = int(stop) + 1, int(ends[stop])
    return [(int(c), int(a) + s, int(a) + e) for c, a, h in zip(p.ctx.tolist(), p.lo.tolist(), hull.tolist(), strict=True) for s, e in out[h]]


def repeated_spans(df: DataFrame, span: int = 400, *, shard_bytes: int = SHARD_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """df(doc_id, text) -> k1, k2, spans array<struct<s, e>>: the removed byte stretches, not yet merged, of each text."""
    spark = df.sparkSession
    anchors = materialize(_anchors(df, span), "anchors")
    # written first, so that the join below has plain exchanges on both sides and a hot anchor's rows can be split
    twice = materialize(anchors.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "met-twice")
    places = materialize(anchors.join(twice, "fp", "left_semi"), "places")
    contexts = places.groupBy(*_CTX).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "left")).alias("one"))
    contexts = materialize(contexts, "contexts")
    by_anchor = contexts.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum("size").alias("total")).filter("kinds > 1")
    unsure = contexts.join(by_anchor, "fp").select(*_CTX, "n", "total", "one.*")
    # one row of each text that such a context is to be read from
    wanted = unsure.groupBy("k1", "k2").agg(F.collect_list(F.struct(*_CTX, "n", "total", "pos", "left")).alias("want"))
    canon = _keyed(df).groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("canon"))
    wanted = wanted.join(canon, ["k1", "k2"]).select("k1", "k2", "want", F.col("canon.doc_id").alias("doc_id"))
    texts = _keyed(df, "text").join(wanted.withColumnRenamed("doc_id", "canon_id"), ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("canon_id")))

    def cut(batches):
        for b in batches:
            for k1, k2, text, want in zip(*(b.column(k) for k in range(4)), strict=True):
                raw, rows = (text.as_py() or "").encode(), want.as_py()
                cols = {c: [r[c] for r in rows] for c in (*_CTX, "n", "total", "left")}
                begin = [r["pos"] - r["left"] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(cols[c], pa.int32() if c in ("size", "left") else pa.int64()) for c in (*_CTX, "n", "total", "left")),
                        pa.array([k1.as_py()] * len(rows), pa.int64()), pa.array([k2.as_py()] * len(rows), pa.int64()), pa.array(begin, pa.int64()),
                        pa.array([raw[s : s + r["size"]] for s, r in zip(begin, rows, strict=True)], pa.binary()),
                    ],
                    [*_CTX, "n", "total", "left", "k1", "k2", "begin", "raw"],
                )

    pieces = texts.select("k1", "k2", "text", "want").mapInArrow(cut, "fp long, c1 long, c2 long, size int, n long, total long, left int, k1 long, k2 long, begin long, raw binary")
    pieces = materialize(pieces, "pieces")
    small, big = pieces.filter(F.col("total") <= anchor_bytes), pieces.filter(F.col("total") > anchor_bytes)
    held = small.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-held // shard_bytes))

    def shard(table: pa.Table) -> pa.Table:
        # rows repeated in the input bring a context twice
        table = table.combine_chunks()
        ids = np.stack([table[c].to_numpy() for c in ("fp", "c1", "c2")], axis=1)
        _, keep = np.unique(ids, axis=0, return_index=True)
        t = table.take(pa.array(keep))
        ids = ids[keep]
        places = list(zip(zip(t["k1"].to_pylist(), t["k2"].to_pylist(), strict=True), t["begin"].to_pylist(), strict=True))
        found = covered_contexts(t["raw"].to_pylist(), t["left"].to_numpy(), ids[:, 0], t["n"].to_numpy(), places, span)
        release_memory()
        f = np.array(found, np.int32).reshape(-1, 3)
        return pa.table([*(pa.array(ids[f[:, 0], k]) for k in range(3)), pa.array(t["size"].to_numpy()[f[:, 0]]), pa.array(f[:, 1]), pa.array(f[:, 2])], names=[*_CTX, "s", "e"])

    # contexts of one anchor share a shard
    dealt = small.withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)))
    parts = dealt.groupBy("shard").applyInArrow(shard, "fp long, c1 long, c2 long, size int, s int, e int")

    def hashed(block: int, chosen: bool):
        """Pieces of ``block`` windows of the contexts, or of the pieces (s, e) of them that are given."""

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    some = b.slice(at, 1000)
                    raws, left, base = some.column("raw").to_pylist(), some.column("left").to_numpy(), np.zeros(some.num_rows, np.int64)
                    if chosen:
                        base, stop = some.column("s").to_numpy(), some.column("e").to_numpy()
                        raws, left = [r[x:y] for r, x, y in zip(raws, base.tolist(), stop.tolist(), strict=True)], left - base
                    p = _Pieces(raws, left, some.column("fp").to_numpy(), span, block)
                    ids = [some.column(c).to_numpy()[p.ctx] for c in _CTX]
                    cols = [*ids, (base[p.ctx] + p.lo).astype(np.int32), (base[p.ctx] + p.hi).astype(np.int32), p.core.view(np.int64), p.h1.view(np.int64), p.h2.view(np.int64), some.column("n").to_numpy()[p.ctx]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*_CTX, "s", "e", "core", "h1", "h2", "n"])

        return run

    if _any(big):
        kind = "fp long, c1 long, c2 long, size int, s int, e int, core long, h1 long, h2 long, n long"
        known = big.dropDuplicates(_CTX)
        rows = known
        for block in (8, 1):
            cut_up = materialize(rows.mapInArrow(hashed(block, block == 1), kind), "cut-up")
            hulls = cut_up.groupBy("core", "h1", "h2").agg(F.sum("n").alias("n"), F.min(F.struct(*_CTX, "s", "e")).alias("one"))
            hulls = materialize(hulls, "hulls")
            whole = cut_up.join(hulls.filter("n > 1").select("h1", "h2"), ["h1", "h2"], "left_semi").select(*_CTX, "s", "e")
            parts = parts.unionByName(whole.distinct())
            if block > 1:  # one of each kind of piece whose core has several goes on to its single windows
                shared = hulls.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core")
                rows = hulls.join(shared, "core", "left_semi").select("one.*", "n").join(known.select(*_CTX, "left", "raw"), _CTX)
    sure = contexts.filter((F.col("n") > 1) & (F.col("size") >= span)).select(*_CTX, F.lit(0).alias("s"), F.col("size").alias("e"))
    found = places.join(sure.unionByName(parts), _CTX)
    begin = F.col("pos") - F.col("left")
    found = found.select("k1", "k2", (begin + F.col("s")).alias("s"), (begin + F.col("e")).alias("e")).distinct()
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _any(df: DataFrame) -> bool:
    return not df.isEmpty()


def _keyed(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, k1, k2 of each row: the halves of the text's md5, read as little-endian as in ``_anchors``."""
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))

    def half(at: int):
        hexa = F.concat(*[F.substring(digest, at + 2 * k, 2) for k in range(7, -1, -1)])
        # two 32-bit halves, as conv() is unsigned
        high, low = F.conv(F.substring(hexa, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hexa, 9, 8), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)

    return df.select("doc_id", half(1).alias("k1"), half(17).alias("k2"), *[F.col(c) for c in more])


def remove_repeats(df: DataFrame, span: int = 400, keep: list[str] | None = None, as_text: bool = False, least_words: int = 0, least_bytes: int = 0, **sizes: int) -> DataFrame:
    """The columns ``keep`` of df (doc_id by default), n_bytes, kept (the remaining bytes), spans (removed, merged).

    With ``as_text`` kept is a string: bytes of characters that a span cuts in part are left out. A merged stretch is
    removed if it has ``least_words`` words (cut ones count) or ``least_bytes`` bytes; by default any is.
    """
    keep = keep or ["doc_id"]
    spans = repeated_spans(df, span, **sizes)
    rows = _keyed(df.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*keep).alias("__kept")), "text", "__kept").join(spans, ["k1", "k2"], "left")

    def run(batches):
        n = len(keep)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                sizes, kept, gone = [], [], []
                for text, spans in zip(some.column(n).to_pylist(), some.column(n + 1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    merged: list[list[int]] = []
                    for x in sorted((x["s"], x["e"]) for x in spans or ()):
                        if merged and x[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x[1])
                        else:
                            merged.append(list(x))
                    if least_words:
                        merged = [x for x in merged if x[1] - x[0] >= least_bytes or len(raw[x[0] : x[1]].split()) >= least_words]
                    parts, done = [], 0
                    for s, e in merged:
                        parts.append(raw[done:s])
                        done = e
                    sizes.append(len(raw))
                    left = b"".join([*parts, raw[done:]])
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                    gone.append([{"s": s, "e": e} for s, e in merged])
                yield pa.RecordBatch.from_arrays([*some.columns[:n], pa.array(sizes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(gone, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], [*some.schema.names[:n], "n_bytes", "kept", "spans"])
        release_memory()

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.select(*[F.col(f"__kept.{c}").alias(c) for c in keep], "text", "spans").mapInArrow(run, f"{schema}, n_bytes long, kept {'string' if as_text else 'binary'}, spans array<struct<s: long, e: long>>")

