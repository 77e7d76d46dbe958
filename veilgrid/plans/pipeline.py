"""Plans: an ordered chain of steps, and the anonymisation of documents end to end."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotate, encode, rebuild

Step = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, steps: list[tuple[str, Step]], dump: str | None = None) -> DataFrame:
    """The named steps in order; the first that fails names itself. ``dump`` names a folder that keeps each step's rows."""

    def apply(now: DataFrame, step: tuple[str, Step]) -> DataFrame:
        try:
            out = step[1](now)
            if dump:
                out.write.mode("overwrite").parquet(f"{dump}/{step[0]}")
            return out
        except Exception as e:
            e.add_note(f"in step {step[0]}")
            raise

    return reduce(apply, steps, df)


def found_entities(docs: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """docs(doc_id, case_id, text) -> case_id, doc_id, first_pos, s, e, type, text of the pattern entities.

    Spans that overlap are one entity, from the first's start to the last's end: nothing that a family found stays.
    """
    spans = docs.select("doc_id", "case_id", "text", annotate.pattern_spans(F.col("text"), families).alias("spans")).filter(F.size("spans") > 0)
    rows = spans.select("doc_id", F.posexplode("spans").alias("ord", "x")).select("doc_id", "ord", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.label").alias("type"))
    whole = rebuild.merged_spans(rows, ["doc_id"]).join(spans.select("doc_id", "case_id", "text"), "doc_id")
    return whole.select("case_id", "doc_id", "s", "e", "type", F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")).alias("text"), F.col("s").alias("first_pos"))


def anonymize(docs: DataFrame, families: tuple[str, ...] = ("EMAIL",), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, case_id, text) -> (doc_id, n_entities, text with identifiers instead of entities; the case map).

    Only texts with an entity take part in the shuffles of the entities; each document's text moves once.
    """
    own = found_entities(docs, families)
    ids = encode.allocate(own, known)
    edits = own.join(ids, ["case_id", "text"]).select("doc_id", "s", "e", F.col("ent_id").alias("replacement"))
    out = rebuild.rebuild(docs.select("doc_id", "text"), edits, ["doc_id"])
    n = edits.groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    return out.join(n, "doc_id", "left").select("doc_id", F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"), "text"), ids
