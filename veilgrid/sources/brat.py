"""Standoff annotations: reading, re-basing to paragraphs, merging, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_standoff(spark: SparkSession, paths) -> DataFrame:
    """doc, tid, label, s, e, text of ``T<n>  LABEL s e  text`` lines; others are left out."""
    rows = spark.read.text(paths).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("doc"), "value")
    return standoff(rows)


def standoff(rows: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    place = F.split(f[1], " ")
    rows = rows.filter((F.size(f) == 3) & F.startswith("value", F.lit("T")) & (F.size(place) == 3))
    return rows.select("doc", f[0].alias("tid"), place[0].alias("label"), place[1].cast("int").alias("s"), place[2].cast("int").alias("e"), F.rtrim(f[2]).alias("text"))


def to_paragraphs(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """texts(doc, text), spans(doc, label, s, e, text) -> doc, line_no, line, label, s, e, agrees.

    Offsets become those in the paragraph; ``agrees`` says whether the text there is the annotated one. A CRLF counts as
    two characters of the file and none of the line.
    """
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.withColumn("begin", F.coalesce(F.sum(F.length("raw") + 1).over(order), F.lit(0))).withColumn("line", F.regexp_replace("raw", "\r$", ""))
    a = spans.withColumnRenamed("doc", "d")
    inside = (F.col("d") == F.col("doc")) & (F.col("s") >= F.col("begin")) & (F.col("e") <= F.col("begin") + F.length("line"))
    out = lines.join(a.withColumnRenamed("text", "noted"), inside)
    s, e = (F.col("s") - F.col("begin")).cast("int"), (F.col("e") - F.col("begin")).cast("int")
    return out.select("doc", "line_no", "line", "label", s.alias("s"), e.alias("e"), (F.substring("line", s + 1, e - s) == F.col("noted")).alias("agrees"))


def conflicts(spans: DataFrame) -> DataFrame:
    """spans(doc, line, label, s, e): pairs on the same line that overlap with different labels, each once."""
    a, b = spans.alias("a"), spans.alias("b")
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")) & (F.col("a.label") < F.col("b.label"))
    return a.join(b, on).select(F.col("a.doc").alias("doc"), F.col("a.line").alias("line"), F.col("a.label").alias("label1"), F.col("a.s").alias("s1"), F.col("a.e").alias("e1"), F.col("b.label").alias("label2"), F.col("b.s").alias("s2"), F.col("b.e").alias("e2"))


def merge(spans: DataFrame) -> DataFrame:
    """Distinct annotations of several folders without those in conflict."""
    spans = spans.select("doc", "line", "label", "s", "e").distinct()
    bad = conflicts(spans)
    both = bad.select("doc", "line", F.col("label1").alias("label"), F.col("s1").alias("s"), F.col("e1").alias("e")).unionByName(bad.select("doc", "line", F.col("label2").alias("label"), F.col("s2").alias("s"), F.col("e2").alias("e")))
    return spans.join(both, ["doc", "line", "label", "s", "e"], "left_anti")


def render(entities: DataFrame) -> DataFrame:
    """entities(doc, type, s, e, text) -> doc, value: a standoff file, numbered in order of place."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy("s", "e", "type"))
    line = F.concat_ws("\t", F.concat(F.lit("T"), n.cast("string")), F.concat_ws(" ", "type", F.col("s").cast("string"), F.col("e").cast("string")), "text")
    rows = entities.select("doc", n.alias("n"), line.alias("line"))
    return rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n").alias("value"))


def label_inventory(spans: DataFrame) -> DataFrame:
    """place, label: O, then B- and I- of each label in order."""
    labels = spans.select("label").distinct()
    pairs = labels.select(F.explode(F.array(F.struct(F.col("label").alias("base"), F.lit(0).alias("k"), F.concat(F.lit("B-"), "label").alias("label")), F.struct(F.col("label").alias("base"), F.lit(1).alias("k"), F.concat(F.lit("I-"), "label").alias("label")))).alias("x")).select("x.*")
    numbered = pairs.select(F.row_number().over(Window.orderBy("base", "k")).alias("place"), "label")
    return labels.sparkSession.createDataFrame([(0, "O")], "place int, label string").unionByName(numbered)
