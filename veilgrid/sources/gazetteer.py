"""Gazetteers, replacement dictionaries, strategy configurations, case maps and rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import multiset_key

RULES = T.StructType([
    T.StructField("max_sequence_length", T.IntegerType()),
    T.StructField("rules", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("conditions", T.ArrayType(T.MapType(T.StringType(), T.StringType())))]))),
])


def _rows(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("at"))


def read_gazetteer(spark: SparkSession, path) -> DataFrame:
    return gazetteer(_rows(spark, path).filter(F.size("f") == 2).select(F.col("f")[0].alias("ner"), F.col("f")[1].alias("name"), "at"))


def gazetteer(rows: DataFrame) -> DataFrame:
    """rows(ner, name, at) -> key, ner, n_words: one entry per set of words, the last one read wins."""
    key = multiset_key(F.col("name"))
    return rows.groupBy(key.alias("key")).agg(F.max_by("ner", "at").alias("ner")).withColumn("n_words", F.size(F.split("key", " ")))


def longest_entry(entries: DataFrame) -> int:
    """Words of the longest entry: the width of the look-ahead window."""
    return entries.agg(F.max("n_words")).first()[0] or 0


def read_replacements(spark: SparkSession, path) -> DataFrame:
    """type, place, candidate: the pool of each type in file order."""
    return replacements(_rows(spark, path).filter(F.size("f") == 2).select(F.col("f")[0].alias("type"), F.col("f")[1].alias("candidate"), "at"))


def replacements(rows: DataFrame) -> DataFrame:
    """rows(type, candidate, at) -> type, place, candidate, trimmed and numbered in order."""
    rows = rows.withColumn("candidate", F.trim("candidate"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("at"))).drop("at")


def read_strategies(spark: SparkSession, path) -> DataFrame:
    return strategies(_rows(spark, path).filter(F.size("f") >= 2).select(F.col("f")[0].alias("type"), F.col("f")[1].alias("value"), "at"))


def strategies(rows: DataFrame) -> DataFrame:
    """rows(type, value, at) -> type, strategy, extra: ``strategy[:extra]``, the last line of a type wins."""
    cut = F.split("value", ":", 2)
    return rows.groupBy("type").agg(F.max_by("value", "at").alias("value")).select("type", F.lower(F.trim(cut[0])).alias("strategy"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("extra"))


def read_case_map(spark: SparkSession, path, case_id: str) -> DataFrame:
    rows = _rows(spark, path).filter(F.size("f") >= 2).select(F.lit(case_id).alias("case_id"), F.col("f")[0].alias("text"), F.col("f")[1].alias("ent_id"), F.get("f", F.lit(2)).alias("replacement"), "at")
    return case_map(rows)


def case_map(rows: DataFrame) -> DataFrame:
    """One row per (case_id, text): the last one."""
    last = rows.groupBy("case_id", "text").agg(F.max_by(F.struct("ent_id", "replacement"), "at").alias("x"))
    return last.select("case_id", "text", "x.ent_id", "x.replacement")


def case_initials(cases: DataFrame) -> DataFrame:
    """cases(case_id, text, replacement) of initials -> case_id, part, letter: what each part of a name stands as; the
    smallest letter where texts disagree. Parts without a letter are left out."""
    cut = lambda c: F.split(F.trim(c), r"[\s-]+")
    both = cases.select("case_id", F.explode(F.arrays_zip(cut("text").alias("part"), cut("replacement").alias("letter"))).alias("x")).select("case_id", "x.part", "x.letter")
    return both.filter("part <> '' and letter <> ''").groupBy("case_id", "part").agg(F.min("letter").alias("letter"))


def upsert_case_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new(case_id, ent_id, replacement): a new replacement follows an old one after a blank."""
    both = old.alias("o").join(new.alias("n"), ["case_id", "ent_id"], "full_outer")
    text = F.concat_ws(" ", F.col("o.replacement"), F.col("n.replacement"))
    return both.select("case_id", "ent_id", F.when(text != "", text).alias("replacement"))


def lookup(entities: DataFrame, cases: DataFrame) -> DataFrame:
    """+ replacement by (case_id, ent_id); null where the case has none yet."""
    return entities.join(cases.filter(F.col("replacement").isNotNull()).select("case_id", "ent_id", "replacement"), ["case_id", "ent_id"], "left")


def rules(text: Column) -> Column:
    """Rule sets from JSON; min is 1 and max 9999 unless given (see operators.rules)."""
    return F.from_json(text, RULES)
