"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9).

Each row gets the exponential key ``-ln(u) / weight`` (u from a hash of doc_id, so reruns agree). A source's target is
met by complete epochs first; the remaining budget is filled by the rows of smallest keys, prefix-summed to the budget.

Scale: prefix sums run over (source, key bucket) sums, so no task holds a source. Only the one bucket per source in
which the budget ends is sorted row by row. Everything is native and spillable.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id hashes as the
empty text; rows with equal doc_id share a key and are ordered by size; an empty table gives an empty mix; extra columns
are ignored; a null, NaN, zero or negative weight counts as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

CYCLE = (3, 1, 2)


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u)/weight with u in (0, 1) from 52 bits of md5(doc_id)."""
    hexa = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    u = (F.conv(hexa, 16, 10).cast("double") + 0.5) / float(2**52)
    w = F.when(weight > 0, F.when(F.isnan(weight), 1.0).otherwise(weight)).otherwise(1.0)
    return -F.log(u) / w


def targets(sizes: DataFrame, ratio: float = 1.5, cap: float = 2.0, cycle: tuple = CYCLE) -> DataFrame:
    """(source, source_size) -> + target, epochs, budget: shares by cyclic weight, capped, excess reshared (water filling).

    Its windows see one row per source, already summed; they never see documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    levels = ranked.withColumns({
        "level": (F.sum("source_size").over(everything) * F.lit(float(ratio)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
        "place": F.row_number().over(fill),
    })
    fits = F.col("level") <= F.col("most") / F.col("w")
    levels = levels.withColumn("water", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("place"))).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("water") * F.col("w"), F.col("most")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return levels.withColumn("target", target).withColumn("epochs", epochs).select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))


def mix(df: DataFrame, labels: DataFrame | None = None, *, ratio: float = 1.5, cap: float = 2.0, cycle: tuple = CYCLE, buckets: int = 4096, carry: list[str] | None = None) -> DataFrame:
    """df(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, times, taken: one row per input row.

    labels(doc_id, weight), one row per doc_id, gives quality weights; others weigh 1. Columns ``carry`` of df are kept.
    """
    # word counting reads the texts once; all that follows reads narrow rows
    carry = carry or []
    rows = df.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"))
    rows = rows.join(labels.select("doc_id", "weight"), "doc_id", "left") if labels is not None else rows.withColumn("weight", F.lit(1.0))
    rows = materialize(rows.select("doc_id", "source", *carry, "size", exponential_key(F.col("doc_id"), F.col("weight").cast("double")).alias("key")), "mix-rows")
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), ratio, cap, cycle)
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_bucket.select("source", "bucket", "bucket_size", F.sum("bucket_size").over(run).alias("end"))
    cut = ends.alias("e").join(plan.alias("p"), F.col("e.source").eqNullSafe(F.col("p.source")))
    # the bucket in which the budget ends: the first whose running sum exceeds it
    over = F.col("e.end") > F.col("p.budget")
    cut = cut.groupBy(F.col("p.source").alias("source")).agg(
        F.first("p.source_size").alias("source_size"), F.first("p.target").alias("target"), F.first("p.epochs").alias("epochs"), F.first("p.budget").alias("budget"),
        F.min(F.when(over, F.col("e.bucket"))).alias("last"), F.min_by(F.when(over, F.col("e.end") - F.col("e.bucket_size")), F.when(over, F.col("e.bucket"))).alias("before"),
    )
    cut = materialize(cut, "mix-plan")
    r = rows.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", *[f"c.{c}" for c in ("source_size", "target", "epochs", "budget", "last", "before")])
    edge = F.col("bucket") == F.col("last")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    sure = r.filter(~edge | F.col("last").isNull()).withColumn("chosen", (F.col("last").isNull() | (F.col("bucket") < F.col("last"))).cast("long"))
    near = r.filter(edge).withColumn("chosen", (middle <= F.col("budget")).cast("long"))
    out = sure.unionByName(near)
    # a budget of nothing selects nothing, not even rows without words
    out = out.withColumn("times", F.col("epochs") + F.when(F.col("budget") > 0, F.col("chosen")).otherwise(0))
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))
