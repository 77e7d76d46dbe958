"""Alignment of two token sequences where offsets are missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _likeness(a: str, b: str) -> int:
    """3 for equal tokens, 2 where one starts with the other, else 0."""
    return 3 if a == b else 2 if a and b and (a.startswith(b) or b.startswith(a)) else 0


def align(x: list[str], y: list[str], reach: int = 5) -> list[tuple[int, int]]:
    """Pairs (i, j) of like tokens, rising on both sides, of the largest total likeness; the earliest where several have it.

    A dynamic programme over the band of places that differ by no more than the lengths do, and ``reach``.
    """
    n, m = len(x), len(y)
    width = reach + abs(n - m)
    # best[i][j]: the largest likeness of x from i on and y from j on; places outside the band count nothing
    best: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(min(m - 1, i + width), max(0, i - width) - 1, -1):
            like = _likeness(x[i], y[j])
            pair = like + best[i + 1].get(j + 1, 0) if like else 0
            best[i][j] = max(pair, best[i + 1].get(j, 0), best[i].get(j + 1, 0))
    out, i, j = [], 0, 0
    while i < n and j < m and best[i].get(j, 0):
        like = _likeness(x[i], y[j])
        if like and best[i][j] == like + best[i + 1].get(j + 1, 0):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i].get(j + 1, 0) == best[i][j]:
            j += 1
        else:
            i += 1
    return out


def align_tokens(docs: DataFrame, reach: int = 5) -> DataFrame:
    """docs(doc_id, x, y: arrays) -> doc_id, i, j."""

    @F.pandas_udf("array<struct<i: int, j: int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"i": a, "j": b} for a, b in align(list(p), list(q), reach)] for p, q in zip(x, y, strict=True)])

    return docs.select("doc_id", F.explode(run("x", "y")).alias("p")).select("doc_id", "p.i", "p.j")
