"""The corpus pipeline: language ID, near-dedup, passage dedup, mixing, tokens. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm import bpe, langid, mixing, neardup, passages, queries
from veilgrid.llm.common import crc_mod, materialize, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A repeated passage is a stretch of repeated PASSAGE_SPAN bytes that holds PASSAGE_WORDS words or PASSAGE_BYTES bytes.
PASSAGE_SPAN, PASSAGE_WORDS, PASSAGE_BYTES = 240, 50, 400


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: those without text or without a letter."""
    profiles = langid.learn(docs.filter((crc_mod(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()))
    return langid.tag(docs, profiles, COLUMNS).filter(F.col("lang_pred") != langid.UND).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the smallest (doc_id, text key), null doc_ids last.

    Null and empty texts are one class, rows that share doc_id and text are one row, an empty table stays empty.
    """
    keyed = docs.select(*COLUMNS, text_key(F.col("text")).alias("__key"))
    kept = neardup.classes(docs).filter("key = class_key").select(F.col("key").alias("__key"), F.col("class_id").alias("doc_id"))
    # the kept doc_ids are few columns wide; texts move once
    same = (keyed["__key"] == kept["__key"]) & keyed["doc_id"].eqNullSafe(kept["doc_id"])
    out = keyed.join(kept, same, "left_semi").withColumn("__row", F.monotonically_increasing_id())
    return _one_each(materialize(out, "near-dedup")).select(*COLUMNS)


def _one_each(rows: DataFrame) -> DataFrame:
    """Of rows that share doc_id and text, the first."""
    first = rows.groupBy("__key", "doc_id").agg(F.min("__row").alias("__row")).select("__row")
    return rows.join(first, "__row", "left_semi")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; characters cut in part go, and documents left without words.

    Words set the limit, as 50 words of short ones are some 270 bytes. Null texts and texts without words go, an empty
    table stays empty, and rows with equal texts repeat each other whole.
    """
    keep = [c for c in COLUMNS if c not in ("text", "n_chars")]
    out = passages.remove_repeats(docs, PASSAGE_SPAN, keep, as_text=True, least_words=PASSAGE_WORDS, least_bytes=PASSAGE_BYTES)
    out = out.withColumnRenamed("kept", "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A text without words costs nothing and goes with its source's epochs, a null
    source is a source, equal rows are taken each on its own, an empty table stays empty.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "mix-input")
    times = mixing.mix(rows, queries.quality_weights(spark, sf_dir), carry=["__row"]).filter("times > 0").select("__row", "times")
    out = rows.join(times, "__row")
    return out.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what the mix holds, a row for each of its rows; null texts have no ids, an empty table stays empty."""
    ids = bpe.encode_decode(docs, queries.tokenizer_path())
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mix_sources", mix_sources), ("tokenize", tokenize)]

#: SQL cannot express language profiles, signatures or byte-pair merges; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
