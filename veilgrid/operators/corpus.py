"""Corpus statistics, entity inventories, dashboards, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(tokens: DataFrame, sentences: DataFrame, entities: DataFrame) -> DataFrame:
    """metric, value: files, tokens, distinct tokens and lower-case tokens, sentences, entities, and entities per type."""
    t = tokens.agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("tokens"), F.countDistinct("form").alias("forms"), F.countDistinct(F.lower("form")).alias("lower_forms"))
    s, e = sentences.agg(F.count("*").alias("sentences")), entities.agg(F.count("*").alias("entities"))
    flat = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    types = entities.groupBy("type").agg(F.count("*").alias("value")).select(F.concat(F.lit("type:"), "type").alias("metric"), "value")
    return flat(t).unionByName(flat(s)).unionByName(flat(e)).unionByName(types)


def inventory(entities: DataFrame) -> DataFrame:
    """text, label, file of all entities, in that order."""
    return entities.select("text", F.col("type").alias("label"), F.col("doc_id").alias("file")).orderBy("text", "label", "file")


def counts_text(entities: DataFrame) -> DataFrame:
    """doc_id, counts: ``TYPE:n`` in order of type."""
    n = entities.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", F.col("n").cast("string")))), ", ").alias("counts"))


def band(percent: Column) -> Column:
    return F.when(percent >= 100, "green").when(percent >= 50, "yellow").when(percent > 0, "orange").otherwise("red")


def progress(files: DataFrame) -> DataFrame:
    """files(corpus, gold, entities) -> corpus, total, gold, entities, percent, band."""
    out = files.groupBy("corpus").agg(F.count("*").alias("total"), F.count_if("gold").alias("gold"), F.sum(F.when(F.col("gold"), F.col("entities")).otherwise(0)).alias("entities"))
    out = out.withColumn("percent", F.floor(F.lit(100) * F.col("gold") / F.col("total")).cast("int"))
    return out.withColumn("band", band(F.col("percent")))


def health(modules: DataFrame) -> DataFrame:
    """modules(place, name, ok) -> ok, failed: whether all are well, and the first that is not."""
    return modules.agg(F.every("ok").alias("ok"), F.min_by("name", F.when(~F.col("ok"), F.col("place"))).alias("failed"))


def queue(tasks: DataFrame) -> DataFrame:
    """Tasks in the order they are due: those with priority first, then by arrival."""
    return tasks.orderBy(F.desc("priority"), "arrived", "task_id")
