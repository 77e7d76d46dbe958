"""Token-sequence rules that rewrite labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_type
from . import bio


def condition(cond: dict, strict: bool = True) -> Column:
    """One condition over form, lemma and ner as a boolean column; a conjunction of what it names.

    Label tests are anchored in strict mode, so that O does not match ORG.
    """
    out = F.lit(True)
    form, lemma = F.col("form"), F.col("lemma")
    first = F.substring(form, 1, 1)
    for key, column, test in (("formFirstLetter", first, {1: first == F.upper(first), 2: first == F.lower(first)}), ("formAllLetters", form, {1: form == F.upper(form), 2: form == F.lower(form)})):
        if int(cond.get(key, 0)):
            out = out & test[int(cond[key])]
    for key, column in (("form", form), ("lemma", lemma)):
        if cond.get(key):
            out = out & column.rlike(f"(?iu){cond[key]}")
        if cond.get(f"{key}MatchCased"):
            out = out & column.rlike(cond[f"{key}MatchCased"])
    if cond.get("ner"):
        out = out & F.coalesce(label_type(F.col("ner")), F.lit("O")).rlike(f"(?iu)^(?:{cond['ner']})$" if strict else f"(?iu){cond['ner']}")
    return out


def single(tokens: DataFrame, rule: dict, by: list[str], strict: bool = True) -> DataFrame:
    """A rule of one condition without counts, natively."""
    cond = rule["conditions"][0]
    new = F.when(condition(cond, strict), F.lit(cond["ann"])).otherwise(F.col("ner"))
    return bio.renormalize(tokens.withColumn("ner", new), by)


class Engine:
    """Longest match wins, the first rule on ties; a match is consumed. Conditions are greedy and never give back."""

    def __init__(self, rules: dict, strict: bool = True):
        self.longest = int(rules.get("max_sequence_length", 20))
        self.rules = [[self._compile(c, strict) for c in r["conditions"]] for r in rules["rules"]]

    @staticmethod
    def _compile(c: dict, strict: bool):
        tests = []
        for key, at in (("form", 0), ("lemma", 1)):
            if c.get(key):
                tests.append(lambda t, rx=re.compile(c[key], re.I), at=at: rx.search(t[at]) is not None)
            if c.get(f"{key}MatchCased"):
                tests.append(lambda t, rx=re.compile(c[f"{key}MatchCased"]), at=at: rx.search(t[at]) is not None)
        if c.get("ner"):
            rx = re.compile(c["ner"], re.I)
            tests.append(lambda t: (rx.fullmatch if strict else rx.search)(t[2]) is not None)
        for key, whole in (("formFirstLetter", False), ("formAllLetters", True)):
            if int(c.get(key, 0)):
                change = str.upper if int(c[key]) == 1 else str.lower
                tests.append(lambda t, whole=whole, change=change: (x := t[0] if whole else t[0][:1]) == change(x))
        return tests, int(c.get("min", 1)), int(c.get("max", 9999)), c.get("ann")

    def match(self, tokens: list, rule: list, strict: bool) -> list | None:
        """New labels of the tokens that the rule covers, None where a condition keeps them."""
        out, at = [], 0
        for tests, least, most, label in rule:
            n = 0
            while n < most and at < len(tokens) and all(t(tokens[at]) for t in tests):
                out.append(label)
                at, n = at + 1, n + 1
            if n < least:
                if at < len(tokens) or strict or not out:
                    return None
                break
        return out

    def apply(self, tokens: list[tuple[str, str, str]], passes: int = 3, strict: bool = True) -> list[str]:
        """tokens (form, lemma, type) -> types."""
        now = [list(t) for t in tokens]
        for _ in range(passes):
            at, changed = 0, False
            while at < len(now):
                window = now[at : at + self.longest]
                best = max((m for r in self.rules if (m := self.match(window, r, strict))), key=len, default=None)
                for k, label in enumerate(best or ()):
                    if label is not None and now[at + k][2] != label:
                        now[at + k][2], changed = label, True
                at += len(best) if best else 1
            if not changed:
                break
        return [t[2] for t in now]


def apply_rules(tokens: DataFrame, rules: dict, by: tuple[str, ...] = ("doc_id", "sent_id"), max_passes: int = 3, strict: bool = True) -> DataFrame:
    """tokens(by, pos, form, lemma, ner) with rewritten ner: a function per sentence, batched through Arrow."""
    by = list(by)
    grouped = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "form", F.coalesce("lemma", "form").alias("lemma"), F.coalesce(label_type(F.col("ner")), F.lit("O")).alias("type")))).alias("t"))

    @F.pandas_udf("array<string>")
    def run(sentences: pd.Series) -> pd.Series:
        engine = Engine(rules, strict)
        return sentences.map(lambda s: engine.apply([(t["form"] or "", t["lemma"] or "", t["type"]) for t in s], max_passes, strict))

    new = grouped.withColumn("n", run("t")).select(*by, F.explode(F.arrays_zip("t", "n")).alias("x")).select(*by, F.col("x.t.pos").alias("pos"), F.col("x.n").alias("__ner"))
    out = tokens.join(new, [*by, "pos"]).withColumn("ner", F.col("__ner")).drop("__ner")
    return bio.renormalize(out, by)
