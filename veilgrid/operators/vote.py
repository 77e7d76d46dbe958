"""Votes of several annotators on the same tokens: DIFF, ADD, INTERSECT, MAJORITY.

Input is long: labels(by, pos, source, ner), source 0 first. One group-by per token replaces N aligned readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_type
from . import bio

ALGORITHMS = ("DIFF", "ADD", "INTERSECT", "MAJORITY")


def check_aligned(labels: DataFrame, by: list[str]) -> DataFrame:
    """by, rows, sources, aligned: every source must label every token once."""
    n = labels.groupBy(*by, "source").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max("n").alias("rows"), F.count("*").alias("sources"), (F.min("n") == F.max("n")).alias("aligned"))


def vote(labels: DataFrame, by: list[str], algorithm: str = "DIFF") -> DataFrame:
    """by, pos, ner: the voted labels in BIO.

    DIFF keeps labels of source 0 whose type no other source has at the token; a body whose begin went becomes one.
    ADD takes the first source that has a label. INTERSECT needs all to agree on a type. MAJORITY needs half of them,
    rounded half to even; ties go to the first source. The last three start an entity where the type changes.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}, not {algorithm!r}")
    rows = labels.withColumn("type", label_type(F.col("ner")))
    w = Window.partitionBy(*by).orderBy("pos")
    if algorithm == "DIFF":
        first = F.col("source") == 0
        own = rows.groupBy(*by, "pos").agg(
            F.max(F.when(first, F.col("ner"))).alias("ner"), F.max(F.when(first, F.col("type"))).alias("type"), F.collect_set(F.when(~first, F.col("type"))).alias("others")
        )
        own = own.withColumn("kept", F.col("type").isNotNull() & ~F.array_contains("others", F.coalesce("type", F.lit(""))))
        before = F.lag("kept", 1, False).over(w)
        begins = F.startswith("ner", F.lit("B-")) | ~before | ~F.lag("type").over(w).eqNullSafe(F.col("type"))
        return own.select(*by, "pos", F.when(~F.col("kept"), "O").otherwise(F.concat(F.when(begins, "B-").otherwise("I-"), "type")).alias("ner"))
    if algorithm == "ADD":
        one = rows.groupBy(*by, "pos").agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("source"))).alias("type"))
    elif algorithm == "INTERSECT":
        one = rows.groupBy(*by, "pos").agg(F.when((F.count("type") == F.count("*")) & (F.min("type") == F.max("type")), F.min("type")).alias("type"))
    else:
        per = rows.groupBy(*by, "pos", "type").agg(F.count("*").alias("n"), F.min("source").alias("first"))
        # void labels vote too, but between equals a type wins, and of types the first source's
        best = F.min_by(F.struct("type", "n"), F.struct(-F.col("n"), F.col("type").isNull(), F.col("first")))
        one = per.groupBy(*by, "pos").agg(best.alias("b"), F.sum("n").alias("total"))
        one = one.select(*by, "pos", F.when(F.col("b.n") >= F.bround(F.col("total") / 2), F.col("b.type")).alias("type"))
    return bio.renormalize(one.withColumn("ner", F.coalesce("type", F.lit("O"))).drop("type"), by)
