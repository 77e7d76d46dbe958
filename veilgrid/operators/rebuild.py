"""Documents with their entities replaced: pieces between kept intervals, joined once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mapping import DELETED


def clusters(edits: DataFrame, by: list[str], order: tuple[str, ...] = ("s", "e")) -> DataFrame:
    """+ cluster: number within ``by`` of the run of intervals [s, e) that overlap one another, directly or through others."""
    w = Window.partitionBy(*by).orderBy(*order)
    covered = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = edits.withColumn("__fresh", F.coalesce(F.col("s") >= covered, F.lit(True)).cast("int"))
    return fresh.withColumn("cluster", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def kept_intervals(edits: DataFrame, by: list[str]) -> DataFrame:
    """edits(by, s, e, ...) without those that start before the end of the last one kept, in order of place.

    Only intervals of one cluster can stand in each other's way, so the fold over kept ends runs within clusters.
    """
    rest = [c for c in edits.columns if c not in (*by, "s", "e")]
    own = clusters(edits, by, ("s", "e", *rest)).groupBy(*by, "cluster").agg(F.array_sort(F.collect_list(F.struct("s", "e", *rest))).alias("x"))

    def step(kept, one):
        return F.when((F.size(kept) == 0) | (one["s"] >= F.element_at(kept, -1)["e"]), F.concat(kept, F.array(one))).otherwise(kept)

    none = F.slice("x", F.lit(1), F.lit(0))
    kept = own.select(*by, F.explode(F.when(F.size("x") == 1, F.col("x")).otherwise(F.aggregate("x", none, step))).alias("k"))
    return kept.select(*[c if c in by else F.col(f"k.`{c}`").alias(c) for c in edits.columns])


def merged_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """spans(by, s, e, type, ord) -> by, s, e, type: each cluster as one span, so no covered character is left out.

    It is of the type of its longest span; of equally long ones the later in order of precedence names it.
    """
    own = clusters(spans, by).groupBy(*by, "cluster")
    return own.agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max_by("type", F.struct(F.col("e") - F.col("s"), "ord", "type")).alias("type")).drop("cluster")


def rebuild(docs: DataFrame, edits: DataFrame, by: list[str], text: str = "text", as_bytes: bool = False) -> DataFrame:
    """docs(by, text) with [s, e) replaced, in characters or in bytes of UTF-8 -> by, text.

    Each edit contributes the text since the edit before and its replacement; the tail ends it. A deletion is an empty
    piece, and the blank beside it stays.
    """
    edits = kept_intervals(edits, by)
    pieces = edits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("s", "e", F.when(F.col("replacement") == DELETED, "").otherwise(F.col("replacement")).alias("r")))).alias("x"))
    rows = docs.join(pieces, by, "left")
    raw = F.col(text).cast("binary") if as_bytes else F.col(text)
    decode = (lambda c: F.decode(c, "UTF-8")) if as_bytes else (lambda c: c)
    size = F.octet_length(raw) if as_bytes else F.length(raw)
    before = F.concat(F.array(F.lit(0)), F.col("x")["e"])
    parts = F.transform(F.arrays_zip(F.col("x").alias("x"), F.slice(before, F.lit(1), F.size("x")).alias("b")), lambda p: F.concat(decode(F.substring(raw, p["b"] + 1, p["x"]["s"] - p["b"])), p["x"]["r"]))
    last = F.element_at(F.col("x")["e"], -1)
    whole = F.concat(F.array_join(parts, ""), decode(F.substring(raw, last + 1, size - last)))
    return rows.select(*by, F.when(F.col("x").isNull(), F.col(text)).otherwise(whole).alias(text))


def entity_edits(tokens: DataFrame, by: list[str], byte_offsets: bool = False) -> DataFrame:
    """tokens(by, replacement, offsets) -> by, s, e, replacement of the tokens that are replaced."""
    s, e = ("bstart", "bend") if byte_offsets else ("start", "end")
    return tokens.filter("replacement <> '_'").select(*by, F.col(s).cast("int").alias("s"), F.col(e).cast("int").alias("e"), "replacement")
