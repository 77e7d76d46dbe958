"""Language identification by hyperdimensional profiles (operator 4).

Every letter of Unicode has its own random bipolar vector, made from a hash of its code point, so no alphabet is fixed and
no table of letters is held. A trigram's vector binds (multiplies) its letters' vectors, permuted by position;
a text's vector bundles (adds) its trigrams' vectors; a language's prototype bundles those of its training texts. The
prediction is the prototype of largest cosine.

Learning is one pass with per-task integer bundles and a sum by (language, dimension); what reaches the driver is
languages x dimensions numbers, however many documents there are. Prediction is row-local.

Defined cases: text null or without a letter: `und`, score 0; rows with null lang teach nothing; no training row: all
`und`; ties between languages go to the smaller name; extra columns are ignored by ``predict`` and kept by ``tag``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory

DIM, KEPT, SLOTS, PENDING, DISTINCT = 1024, 8_192, 1 << 18, 2_000_000, 500_000
UND = "und"
_BITS = np.uint64(21)  # of a code point
_POINT = np.uint64((1 << 21) - 1)
_WORDS = np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Code point -> its letter as a code point, cases folded; 0 is all that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            out[p] = ord(low) if len(low) == 1 else p
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter_bits(letters: np.ndarray, place: int) -> np.ndarray:
    """uint64 [n, DIM / 64]: signs of the letters' random vectors, permuted ``place`` times (bits and words turn by one)."""
    own = _mix(letters.astype(np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03) + _WORDS)
    if place:
        own = (own << np.uint64(place)) | (own >> np.uint64(64 - place))
    return np.roll(own, place, axis=1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """int8 [n, DIM] of trigrams: bound letter vectors. The product of signs is the exclusive or of their bits."""
    g = grams.astype(np.uint64)
    bits = _letter_bits(g >> (_BITS + _BITS), 2) ^ _letter_bits((g >> _BITS) & _POINT, 1) ^ _letter_bits(g & _POINT, 0)
    return 1 - 2 * np.unpackbits(bits.view(np.uint8), axis=1).view(np.int8)


def trigrams(text: str | None) -> np.ndarray:
    """Trigrams of a text, three code points in an int64; runs of other characters count as one space, and one space stands
    at either end."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    code = _letters()[raw]
    if not code.any():
        return np.empty(0, np.int64)
    keep = code != 0
    keep[1:] |= code[:-1] != 0  # the first of a run of non-letters
    code = np.concatenate([[0], code[keep], [0]]).astype(np.int64)
    if code[1] == 0:
        code = code[1:]
    if len(code) > 3 and code[-2] == 0:
        code = code[:-1]
    return (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]


def _counted(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, sorted, and their summed counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


class _Bundles:
    """Bundles of languages. Trigrams are counted first; past DISTINCT of them, counts go into the vectors and start anew."""

    def __init__(self):
        self.sums: dict[str, np.ndarray] = {}
        self.counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.fresh: dict[str, list[np.ndarray]] = {}
        self.pending = 0

    def add(self, lang: str, grams: np.ndarray) -> None:
        self.fresh.setdefault(lang, []).append(grams)
        self.pending += len(grams)
        if self.pending > PENDING:
            self._count()
            if sum(len(g) for g, _ in self.counts.values()) > DISTINCT:
                self._bundle()

    def _count(self) -> None:
        for lang, parts in self.fresh.items():
            new, n = np.unique(np.concatenate(parts), return_counts=True)
            old, m = self.counts.get(lang, (new[:0], n[:0]))
            self.counts[lang] = _counted(np.concatenate([old, new]), np.concatenate([m, n]))
        self.fresh, self.pending = {}, 0

    def _bundle(self) -> None:
        for lang, (grams, n) in self.counts.items():
            v = self.sums.setdefault(lang, np.zeros(DIM, np.float64))
            for at in range(0, len(grams), 4096):  # sums of integers below 2 ** 53 are exact in any order
                v += n[at : at + 4096].astype(np.float64) @ gram_vectors(grams[at : at + 4096]).astype(np.float64)
        self.counts = {}

    def all(self) -> dict[str, np.ndarray]:
        self._count()
        self._bundle()
        return self.sums


class Profiles:
    """Prototypes of languages, unit length."""

    def __init__(self, langs: list[str], vectors: np.ndarray):
        self.langs = langs
        size = np.linalg.norm(vectors, axis=1, keepdims=True) if len(langs) else np.ones((0, 1))
        self.unit = (vectors / np.where(size > 0, size, 1)).astype(np.float32)
        self.key, self.row = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
        self.table, self.used = np.empty((256, DIM), np.float32), 0

    def _bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors. The first KEPT distinct trigrams' vectors are kept ready, later ones are rebuilt."""
        slot = (_mix(grams.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
        free = np.flatnonzero(self.key[slot] < 0)[: KEPT - self.used]
        if len(free):
            free = free[np.unique(slot[free], return_index=True)[1]]
            new = grams[free]
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.used : self.used + len(new)] = gram_vectors(new)
            self.key[slot[free]] = new
            self.row[slot[free]] = self.used + np.arange(len(new))
            self.used += len(new)
        rows, known = self.row[slot], self.key[slot] == grams
        if known.all():
            return counts @ self.table[rows]
        v = counts[known] @ self.table[rows[known]]
        other, counts = grams[~known], counts[~known]
        for at in range(0, len(other), 4096):
            v = v + counts[at : at + 4096] @ gram_vectors(other[at : at + 4096]).astype(np.float32)
        return v

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = np.unique(trigrams(text), return_counts=True)
        if not len(grams) or not self.langs:
            return UND, 0.0
        v = self._bundle(grams, counts.astype(np.float32))
        size = float(np.linalg.norm(v))
        scores = self.unit @ v / (size or 1)
        best = int(np.argmax(scores))
        return self.langs[best], min(1.0, max(0.0, float(scores[best])))


def learn(df: DataFrame) -> Profiles:
    """df(text, lang) -> prototypes; the driver receives languages x DIM sums."""

    def run(batches):
        found = _Bundles()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang is not None and text:
                    found.add(lang, trigrams(text))
        for lang, v in found.all().items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v.astype(np.int64))], ["lang", "dim", "value"])
        release_memory()

    rows = df.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r.lang for r in rows})
    at = {x: k for k, x in enumerate(langs)}
    vectors = np.zeros((len(langs), DIM))
    for r in rows:
        vectors[at[r.lang], r.dim] = r.value
    return Profiles(langs, vectors)


def tag(df: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of df, then lang_pred and score, predicted from text alone."""
    langs, unit, n = profiles.langs, profiles.unit, len(keep)

    def run(batches):
        p = Profiles(langs, unit)
        for b in batches:
            found = [p.predict(t) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names[:n], "lang_pred", "score"])
        release_memory()

    source = df.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keep)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(df: DataFrame, training: Column, keep: list[str]) -> DataFrame:
    """Learn from the rows where ``training`` holds and lang is not null, then tag every row."""
    return tag(df, learn(df.filter(training & F.col("lang").isNotNull())), keep)
