"""Replacements of entities by strategy: character, counter, initials, dictionary, or a fallback pattern.

Allocation is set-based: entities and candidates are ranked within (case, type, gender, words) and joined on rank, modulo
the pool's size. It is deterministic, replayable and free of repeats while the pool lasts. Nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import apply_suffix, entity_suffix, entity_type, plain_id, stable_number

DELETED = "!DELETE!"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def character(ent_id: Column, pattern: Column, seed: int = 0) -> Column:
    """3 to 10 repetitions of the pattern, by a hash of the identifier."""
    return F.repeat(pattern, (3 + F.pmod(stable_number(F.concat(ent_id, F.lit(f":{seed}"))), F.lit(8))).cast("int"))


def counter(entities: DataFrame) -> DataFrame:
    """entities(case_id, type, seq, extra) + replacement: extra and a number that grows per case and type."""
    n = F.row_number().over(Window.partitionBy("case_id", "type").orderBy("seq"))
    return entities.withColumn("replacement", F.trim(F.concat_ws(" ", "extra", n.cast("string"))))


def initials(entities: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """entities(case_id, seq, text, extra) + replacement: one letter for each part of a name, the same for equal parts of
    a case. used(case_id, letter) are taken; beyond Z letters double."""
    parts = entities.select("case_id", "seq", F.posexplode(F.split("text", r"[\s]+")).alias("word_no", "word"))
    parts = parts.select("case_id", "seq", "word_no", F.posexplode(F.split("word", "-")).alias("part_no", "part"))
    first = parts.groupBy("case_id", "part").agg(F.min(F.struct("seq", "word_no", "part_no")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("at")) - 1
    every = F.array(*[F.lit(c) for c in LETTERS])
    if used is None:
        free = first.withColumn("free", every)
    else:
        taken = used.groupBy("case_id").agg(F.collect_set("letter").alias("taken"))
        free = first.join(taken, "case_id", "left").withColumn("free", F.array_except(every, F.coalesce("taken", F.array().cast("array<string>"))))
    free = free.withColumn("rank", rank)
    size = F.size("free")
    letter = F.repeat(F.element_at("free", (F.pmod(F.col("rank"), size) + 1).cast("int")), (F.floor(F.col("rank") / size) + 1).cast("int"))
    named = parts.join(free.select("case_id", "part", letter.alias("letter")), ["case_id", "part"])
    word = named.groupBy("case_id", "seq", "word_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part_no", "letter")))["letter"], "-").alias("short"))
    text = word.groupBy("case_id", "seq").agg(F.array_join(F.array_sort(F.collect_list(F.struct("word_no", "short")))["short"], " ").alias("replacement"))
    return entities.join(text, ["case_id", "seq"])


def from_pool(entities: DataFrame, pool: DataFrame) -> DataFrame:
    """entities(case_id, type, seq, text) + replacement, wrapped, from pool(type, place, candidate).

    Names whose first word ends in a draw from such candidates of as many words, then from any such, then from all; other
    names likewise from the rest. ``wrapped`` tells that the pool was too small. Types without a pool get null.
    """
    gender = lambda c: F.endswith(F.split_part(c, F.lit(" "), F.lit(1)), F.lit("a"))
    size = lambda c: F.size(F.split(c, " "))
    pool = pool.select("type", "place", "candidate", gender(F.col("candidate")).alias("g"), size(F.col("candidate")).alias("n"))
    keys = (["type", "g", "n"], ["type", "g"], ["type"])
    out = entities.withColumns({"g": gender(F.col("text")), "n": size(F.col("text"))})
    # the first level whose pool is not empty, then a rank among the entities that draw at it
    level = F.lit(None).cast("int")
    for k, own in reversed(list(enumerate(keys))):
        out = out.join(pool.groupBy(*own).agg(F.count("*").alias(f"size{k}")), own, "left")
        level = F.when(F.col(f"size{k}").isNotNull(), k).otherwise(level)
    out = out.withColumn("level", level)
    parts = []
    for k, own in enumerate(keys):
        drawn = out.filter(F.col("level") == k).withColumn("draw", F.row_number().over(Window.partitionBy("case_id", *own).orderBy("seq")) - 1)
        placed = pool.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy("place")) - 1).select(*own, "rank", "candidate")
        drawn = drawn.withColumns({"rank": F.pmod("draw", F.col(f"size{k}")).cast("int"), "wrapped": F.col("draw") >= F.col(f"size{k}")})
        parts.append(drawn.join(placed, [*own, "rank"], "left").select(*entities.columns, F.col("candidate").alias("replacement"), "wrapped"))
    parts.append(out.filter("level is null").select(*entities.columns, F.lit(None).cast("string").alias("replacement"), F.lit(False).alias("wrapped")))
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def allocate(entities: DataFrame, strategies: DataFrame, pool: DataFrame, pattern: str = "X", seed: int = 0) -> DataFrame:
    """entities(case_id, text, ent_id, seq) -> + type, strategy, replacement: each by its type's strategy.

    Types without a strategy draw from the pool; types without a pool get the fallback pattern.
    """
    rows = entities.withColumn("type", entity_type(F.col("ent_id"))).join(strategies, "type", "left")
    rows = rows.withColumns({"strategy": F.coalesce("strategy", F.lit("dictionary")), "extra": F.coalesce("extra", F.lit(""))})
    keep = ["case_id", "text", "ent_id", "seq", "type", "strategy", "extra"]
    rows = rows.select(*keep)
    mark = F.when(F.col("extra") == "", F.lit(pattern)).otherwise(F.col("extra"))
    done = rows.filter("strategy = 'character'").withColumn("replacement", character(F.col("ent_id"), mark, seed))
    done = done.unionByName(counter(rows.filter("strategy = 'counter'"))).unionByName(initials(rows.filter("strategy = 'initials'")).select(*keep, "replacement"))
    drawn = from_pool(rows.filter("strategy not in ('character', 'counter', 'initials')"), pool).drop("wrapped")
    drawn = drawn.withColumn("replacement", F.coalesce("replacement", character(F.col("ent_id"), F.lit(pattern), seed)))
    return done.unionByName(drawn)


def token_of(replacement: Column, ner: Column, left: Column, suffix: Column, dictionary: Column) -> Column:
    """What stands for one token of a mapped entity.

    left: tokens of the entity from here on. The last token takes the last word, and so on back; a begin takes all words
    that are over; a body without a word of its own is deleted. Dictionary replacements carry the entity's case suffix.
    """
    whole = F.when(dictionary, apply_suffix(replacement, suffix)).otherwise(replacement)
    words = F.split(whole, " ")
    n = F.size(words)
    begin = F.startswith(ner, F.lit("B-"))
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(n - left + 1, F.lit(1))), " ")
    body = F.when(n >= left + 1, F.get(words, n - left)).otherwise(F.lit(DELETED))
    return F.when(begin, head).otherwise(body)


def replace_rows(tokens: DataFrame, mapped: DataFrame) -> DataFrame:
    """tokens(case_id, doc_id, pos, form, ner, ent_id) + replacement: ``_`` outside entities.

    mapped(case_id, ent_id, strategy, replacement), one row per entity.
    """
    from . import bio

    rows = bio.reverse_counter(tokens, ["case_id", "doc_id"]).withColumn("plain", plain_id(F.col("ent_id")))
    m = mapped.select("case_id", F.col("ent_id").alias("plain"), "strategy", F.col("replacement").alias("whole"))
    rows = rows.join(m, ["case_id", "plain"], "left")
    sfx = entity_suffix(F.col("ent_id"))
    sfx = F.when(F.startswith("ner", F.lit("B-")), sfx).otherwise(F.lit(""))
    one = token_of(F.col("whole"), F.col("ner"), F.col("left"), sfx, F.col("strategy") == "dictionary")
    return rows.withColumn("replacement", F.when(F.col("ent_id") == "_", "_").otherwise(F.coalesce(one, F.lit("_")))).drop("plain", "whole", "strategy", "left", "type", "ent_no")
