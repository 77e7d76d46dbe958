"""Dictionary and uniform matching: windows of tokens against sets of words, leftmost longest, without overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem_of
from . import bio


def candidates(tokens: DataFrame, entries: DataFrame, by: list[str], longest: int, keys: list[str], word: Column | None = None, first: Column | None = None) -> DataFrame:
    """by, at, n, ner: the longest entry that starts at each token.

    tokens(by, at, form): ``at`` counts from 0 in each sentence. Windows of up to ``longest`` words become sorted keys,
    which an equi-join looks up; keys(columns of by that entries share) restrict it to a document's own entries.
    """
    w = Window.partitionBy(*by).orderBy("at").rowsBetween(0, longest - 1)
    rows = tokens.withColumn("__w", F.collect_list(F.lower(word if word is not None else F.col("form"))).over(w))
    if first is not None:
        rows = rows.filter(first)
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("__w")))
    rows = rows.select(*by, "at", F.explode(F.transform(sizes, lambda n: F.struct(n.alias("n"), F.array_join(F.array_sort(F.slice("__w", F.lit(1), n)), " ").alias("key")))).alias("x")).select(*by, "at", "x.n", "x.key")
    hits = rows.join(entries.select(*keys, "key", "ner"), [*keys, "key"])
    return hits.groupBy(*by, "at").agg(F.max_by(F.struct("n", "ner"), "n").alias("b")).select(*by, "at", "b.n", "b.ner")


def leftmost(found: DataFrame, by: list[str]) -> DataFrame:
    """Of candidates, those a left-to-right scan takes: the next one starts where the last one ended, or later.

    One fold per sentence over its sorted candidates.
    """
    rows = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "n", "ner"))).alias("c"))
    kind = "array<struct<at: int, n: int, ner: string>>"
    zero = F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("taken"))

    def step(acc: Column, c: Column) -> Column:
        one = F.array(F.struct(c["at"].cast("int").alias("at"), c["n"].cast("int").alias("n"), c["ner"].alias("ner")))
        return F.when(c["at"] >= acc["free"], F.struct((c["at"] + c["n"]).cast("int").alias("free"), F.concat(acc["taken"], one).alias("taken"))).otherwise(acc)

    return rows.select(*by, F.explode(F.aggregate("c", zero, step, lambda a: a["taken"])).alias("x")).select(*by, "x.at", "x.n", "x.ner")


def _spread(taken: DataFrame, by: list[str]) -> DataFrame:
    covered = taken.select(*by, "at", "ner", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("word_no"))
    return covered.select(*by, "word_no", F.concat(F.when(F.col("word_no") == F.col("at"), "B-").otherwise("I-"), "ner").alias("__ner"))


def dictionary(tokens: DataFrame, entries: DataFrame, longest: int, by: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """tokens(by, pos, form) + ner from a gazetteer(key, ner). Tokens are stripped of case suffixes, entries are not.

    Hyphens are no words of a window; those inside a match belong to it. A match starts with a capital letter.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("word_no", F.sum((F.col("form") != "-").cast("int")).over(w) - 1)
    words = rows.filter("form <> '-'").select(*by, F.col("word_no").cast("int").alias("at"), "form")
    found = candidates(words, entries, by, longest, [], stem_of(F.col("form")), F.col("form").rlike(r"^\p{Lu}"))
    labels = _spread(leftmost(found, by), by)
    out = rows.join(labels, [*by, "word_no"], "left")
    # a hyphen takes the label of the words around it: that of the word before, if the next one goes on
    order = Window.partitionBy(*by).orderBy("pos")
    ahead = F.lead("__ner").over(order)
    hyphen = F.when(F.startswith(ahead, F.lit("I-")), ahead)
    ner = F.when(F.col("form") == "-", F.coalesce(hyphen, F.lit("O"))).otherwise(F.coalesce("__ner", F.lit("O")))
    return out.withColumn("ner", ner).drop("__ner", "word_no")


def uniform(tokens: DataFrame, min_words: int = 1, by: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """One type per entity text and document: each set of words takes its most frequent type, ties the smaller one.

    ``min_words`` bounds what is learned, not what is matched. Unmatched tokens become O.
    """
    by = list(by)
    own = bio.entities(tokens.withColumns({"start": F.lit(0), "end": F.lit(0)}), by).filter(F.col("n_tok") >= min_words)
    key = F.array_join(F.array_sort(F.split(F.lower("text"), " ")), " ")
    counts = own.groupBy("doc_id", key.alias("key"), "type").agg(F.count("*").alias("n"), F.max("n_tok").alias("n_tok"))
    entries = counts.groupBy("doc_id", "key").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("ner"), F.max("n_tok").alias("n_tok"))
    longest = entries.agg(F.max("n_tok")).first()[0] or 1
    at = F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1
    rows = tokens.withColumn("word_no", at)
    found = candidates(rows.select(*by, F.col("word_no").alias("at"), "form"), entries, by, longest, ["doc_id"])
    labels = _spread(leftmost(found, by), by)
    out = rows.drop("ner").join(labels, [*by, "word_no"], "left").withColumn("ner", F.coalesce("__ner", F.lit("O"))).drop("__ner", "word_no")
    return bio.renormalize(out, by)


def reject_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """Names with digits or punctuation that no name holds."""
    return rows.filter(~F.col(name).rlike(r"[0-9,.;:'+=|\\]"))


def build_gazetteer(sources: list[DataFrame], frequencies: DataFrame, most: int = 100, least: int = 3) -> DataFrame:
    """sources(type, name, at), frequencies(word, n) -> type, name: admissible, rare enough, first spelling of each name."""
    rows = reject_names(reduce(lambda a, b: a.unionByName(b), sources)).filter(F.octet_length("name") >= least)
    common = frequencies.filter(F.col("n") >= most).select(F.col("word").alias("low"))
    rows = rows.withColumn("low", F.lower("name")).join(common, "low", "left_anti")
    return rows.groupBy("type", "low").agg(F.min_by("name", "at").alias("name")).select("type", "name")


def clean_external_names(rows: DataFrame) -> DataFrame:
    """External name lists(kind, name, encoding): + signs are blanks; persons all in capitals or with ``din`` go, and rows not in UTF-8."""
    rows = rows.withColumn("name", F.replace("name", F.lit("+"), F.lit(" "))).filter(F.col("encoding") == "u")
    person = F.col("kind") == "P"
    return rows.filter(~(person & ((F.col("name") == F.upper("name")) | F.lower("name").rlike(r"\bdin\b"))))


def dictionary_counts(entries: DataFrame) -> DataFrame:
    """type, n: entries per type and TOTAL."""
    return entries.rollup("type").agg(F.count("*").alias("n")).withColumn("type", F.coalesce("type", F.lit("TOTAL")))
