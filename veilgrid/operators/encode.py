"""Case-wide entity identifiers: #TYPEn by first appearance, stable across the documents of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem_of, suffix_of
from . import bio


def entity_rows(tokens: DataFrame, by: tuple[str, ...] = ("case_id", "doc_id")) -> DataFrame:
    """tokens(by, pos, form, ner) -> + ent_no, type, stem, sfx, text: entities run across sentences; case suffixes of all
    their tokens are stripped from the key."""
    rows = bio.islands(tokens, list(by))
    rows = rows.withColumns({"stem": stem_of(F.col("form")), "sfx": suffix_of(F.col("form"))})
    inside = F.col("ent_no").isNotNull()
    forms = F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "stem"))).over(Window.partitionBy(*by, "ent_no")))["stem"]
    return rows.withColumn("text", F.when(inside, F.array_join(forms, " ")))


def allocate(entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """entities(case_id, doc_id, first_pos, type, text), known(case_id, text, ent_id) -> case_id, text, ent_id, seq.

    A text's first type names it, whatever type it has later. Numbers run through all types of a case and go on from the
    known ones. Ranks are per case; a case is a bounded set of documents.
    """
    first = entities.groupBy("case_id", "text").agg(F.min_by("type", F.struct("doc_id", "first_pos")).alias("type"), F.min(F.struct("doc_id", "first_pos")).alias("at"))
    if known is not None:
        first = first.join(known.select("case_id", "text"), ["case_id", "text"], "left_anti")
        base = known.groupBy("case_id").agg(F.count("*").alias("base"))
        first = first.join(base, "case_id", "left")
    else:
        first = first.withColumn("base", F.lit(0))
    seq = (F.coalesce("base", F.lit(0)) + F.row_number().over(Window.partitionBy("case_id").orderBy("at"))).cast("int")
    new = first.withColumn("seq", seq).select("case_id", "text", F.concat(F.lit("#"), "type", F.col("seq").cast("string")).alias("ent_id"), "seq")
    if known is None:
        return new
    old = known.select("case_id", "text", "ent_id", F.regexp_extract("ent_id", r"(\d+)", 1).cast("int").alias("seq"))
    return old.unionByName(new)


def encode(tokens: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """tokens(case_id, doc_id, pos, form, ner) -> (tokens + ent_id, case map). Void tokens have ``_``; a token whose case
    suffix was stripped carries it: #PER2_ei."""
    rows = entity_rows(tokens)
    own = rows.filter("ent_no is not null").groupBy("case_id", "doc_id", "ent_no", "type", "text").agg(F.min("pos").alias("first_pos"))
    ids = allocate(own, known)
    out = rows.join(ids.select("case_id", "text", "ent_id"), ["case_id", "text"], "left")
    ent_id = F.when(F.col("ent_no").isNull(), "_").otherwise(F.when(F.col("sfx") == "", F.col("ent_id")).otherwise(F.concat_ws("_", "ent_id", "sfx")))
    return out.withColumn("ent_id", ent_id).drop("text", "stem", "sfx", "type", "ent_no"), ids
