"""BIO labels and entities: runs of one type over ordered tokens. Every other operator uses these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_type


def renormalize(tokens: DataFrame, by: list[str], order: str = "pos", ner: str = "ner") -> DataFrame:
    """``ner`` rewritten: B- where the type differs from the token before, else I-. Neighbours of one type merge."""
    w = Window.partitionBy(*by).orderBy(order)
    kind = label_type(F.col(ner))
    same = kind.eqNullSafe(F.lag(kind).over(w))
    return tokens.withColumn(ner, F.when(kind.isNull(), "O").otherwise(F.concat(F.when(same, "I-").otherwise("B-"), kind)))


def entity_starts(ner: Column, before: Column) -> Column:
    """Whether an entity starts: B-, or another type than before, or nothing before."""
    kind = label_type(ner)
    return kind.isNotNull() & (ner.startswith("B-") | ~kind.eqNullSafe(label_type(before)))


def islands(tokens: DataFrame, by: list[str], order: str = "pos", ner: str = "ner") -> DataFrame:
    """+ type and ent_no: entities numbered within ``by``, null outside."""
    w = Window.partitionBy(*by).orderBy(order)
    start = entity_starts(F.col(ner), F.lag(ner).over(w)).cast("int")
    rows = tokens.withColumns({"type": label_type(F.col(ner)), "__start": start})
    number = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("ent_no", F.when(F.col("type").isNotNull(), number)).drop("__start")


def entities(tokens: DataFrame, by: list[str], order: str = "pos", ner: str = "ner") -> DataFrame:
    """by, ent_no, type, s, e, n_tok, first_pos, text: one row per entity. tokens carry form, start, end."""
    rows = islands(tokens, by, order, ner).filter("ent_no is not null")
    forms = F.array_sort(F.collect_list(F.struct(order, "form")))["form"]
    return rows.groupBy(*by, "ent_no").agg(
        F.first("type").alias("type"), F.min("start").alias("s"), F.max("end").alias("e"), F.count("*").cast("int").alias("n_tok"), F.min(order).alias("first_pos"), F.array_join(forms, " ").alias("text")
    )


def reverse_counter(tokens: DataFrame, by: list[str], order: str = "pos", ner: str = "ner") -> DataFrame:
    """+ left: tokens of the entity from here to its end; its last has 1. Null outside."""
    rows = islands(tokens, by, order, ner)
    w = Window.partitionBy(*by, "ent_no").orderBy(F.desc(order))
    return rows.withColumn("left", F.when(F.col("ent_no").isNotNull(), F.row_number().over(w)))


def next_label(tokens: DataFrame, by: list[str], order: str = "pos", ner: str = "ner") -> DataFrame:
    return tokens.withColumn("ner_next", F.coalesce(F.lead(ner).over(Window.partitionBy(*by).orderBy(order)), F.lit("O")))


def from_flat(tokens: DataFrame, by: list[str], order: str = "pos", label: str = "label") -> DataFrame:
    """Flat labels to BIO across sentences: I- after the same label, B- else."""
    return renormalize(tokens.withColumn("ner", F.coalesce(label, F.lit("O"))), by, order)


def repair(tokens: DataFrame, by: list[str], order: str = "pos", ner: str = "ner", gap: int = 1) -> DataFrame:
    """Model output made consistent: runs broken by at most ``gap`` void tokens are one entity of its most frequent type.

    Ties go to the smaller type. A run that reaches the end is repaired like any other.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = tokens.withColumn("type", label_type(F.col(ner))).withColumn("__at", F.row_number().over(w))
    full = F.when(F.col("type").isNotNull(), F.col("__at"))
    before = F.max(full).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(full).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"__before": before, "__after": after})
    inside = F.col("type").isNotNull() | (F.col("__after") - F.col("__before") - 1 <= gap)
    start = F.col("type").isNotNull() & (F.col("__before").isNull() | (F.col("__at") - F.col("__before") - 1 > gap))
    rows = rows.withColumn("__run", F.when(inside, F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    votes = rows.filter("__run is not null and type is not null").groupBy(*by, "__run", "type").agg(F.count("*").alias("n"))
    best = votes.groupBy(*by, "__run").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("best"))
    out = rows.join(best, [*by, "__run"], "left").withColumn(ner, F.coalesce("best", F.lit("O")))
    again = Window.partitionBy(*by).orderBy(order)
    same = F.col("__run").eqNullSafe(F.lag("__run").over(again))
    out = out.withColumn(ner, F.when(F.col(ner) == "O", "O").otherwise(F.concat(F.when(same, "I-").otherwise("B-"), F.col(ner))))
    return out.drop("type", "best", "__at", "__before", "__after", "__run")


def merge_contiguous(tokens: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """by, seg, text, start, end: tokens that touch, joined."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.coalesce((F.lag("end").over(w) != F.col("start")).cast("int"), F.lit(1))
    rows = tokens.withColumn("__fresh", fresh).withColumn("seg", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    forms = F.array_sort(F.collect_list(F.struct(order, "form")))["form"]
    return rows.groupBy(*by, "seg").agg(F.array_join(forms, "").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))
