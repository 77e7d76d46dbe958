"""Gold against predicted: token labels by span overlap, confusion, precision and recall, agreement, span scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_number


def token_labels(tokens: DataFrame, spans: DataFrame, by: list[str], name: str, contained: bool = False) -> DataFrame:
    """tokens(by, pos, start, end) + name: label of the first span (by ord) that overlaps, or contains, the token; else O."""
    test = (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")) if contained else (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))
    hit = tokens.select(*by, "pos", "start", "end").join(spans.select(*by, "ord", "s", "e", "label"), by).filter(test)
    first = hit.groupBy(*by, "pos").agg(F.min_by("label", "ord").alias("__l"))
    return tokens.join(first, [*by, "pos"], "left").withColumn(name, F.coalesce("__l", F.lit("O"))).drop("__l")


def confusion(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """pairs(gold, pred) -> gold and a column of counts per predicted label."""
    grouped = pairs.groupBy("gold").pivot("pred", labels) if labels else pairs.groupBy("gold").pivot("pred")
    return grouped.count().na.fill(0)


def report(pairs: DataFrame) -> DataFrame:
    """label, tp, n_gold, n_pred, precision, recall, f1 of each label; pairs where both are O do not count."""
    pairs = pairs.filter("not (gold = 'O' and pred = 'O')")
    one = F.explode(F.array_distinct(F.array(F.struct(F.col("gold").alias("label")), F.struct(F.col("pred").alias("label"))))).alias("x")
    rows = pairs.select("gold", "pred", one).select("gold", "pred", F.col("x.label").alias("label"))
    c = rows.groupBy("label").agg(F.count_if((F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label"))).alias("tp"), F.count_if(F.col("gold") == F.col("label")).alias("n_gold"), F.count_if(F.col("pred") == F.col("label")).alias("n_pred"))
    return c.transform(scores)


def scores(counts: DataFrame) -> DataFrame:
    """counts(tp, n_gold, n_pred) + precision, recall, f1; 0 where undefined, rounded to 6 digits."""
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f, 6)})


def averages(rep: DataFrame) -> DataFrame:
    """kind, precision, recall, f1: macro and weighted averages of a report."""
    rep = rep.filter("label <> 'O'")
    total = F.sum("n_gold")
    macro = rep.agg(F.lit("macro").alias("kind"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])
    weighted = rep.agg(F.lit("weighted").alias("kind"), *[F.round(F.sum(F.col(c) * F.col("n_gold")) / total, 6).alias(c) for c in ("precision", "recall", "f1")])
    return macro.unionByName(weighted)


def kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs(by, a, b) -> by, n, kappa (Cohen's, two digits)."""
    by = by or []
    cell = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    n = cell.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    rows, cols = cell.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("x")), cell.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    out = n.join(chance, by, "left") if by else n.join(chance, how="cross")  # both sides are one row
    po, pe = F.col("agree") / F.col("n"), F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*by, "n", F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 2).alias("kappa"))


def pairwise_kappa(marks: DataFrame, by: list[str]) -> DataFrame:
    """marks(annotator, by, label) -> one, two, n, kappa of each two annotators over what both have marked."""
    a, b = (marks.select(*by, F.col("annotator").alias(who), F.col("label").alias(x)) for who, x in (("one", "a"), ("two", "b")))
    return kappa(a.join(b, by).filter("one < two"), ["one", "two"])


def char_overlap(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """label, tp, n_gold, n_pred, ...: characters that gold and predicted spans(by, s, e, label) share, without exploding them."""
    g, p = gold.alias("g"), pred.alias("p")
    on = reduce(lambda a, b: a & b, [F.col(f"g.{c}") == F.col(f"p.{c}") for c in [*by, "label"]]) & (F.col("g.s") < F.col("p.e")) & (F.col("p.s") < F.col("g.e"))
    both = g.join(p, on).groupBy(F.col("g.label").alias("label")).agg(F.sum(F.least("g.e", "p.e") - F.greatest("g.s", "p.s")).alias("tp"))
    size = lambda df, name: df.groupBy("label").agg(F.sum(F.col("e") - F.col("s")).alias(name))
    out = size(gold, "n_gold").join(size(pred, "n_pred"), "label", "full_outer").join(both, "label", "left").na.fill(0)
    return scores(out)


def span_f1(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """label, tp, n_gold, n_pred, ...: exact spans; macro averages follow from ``averages``."""
    keys = [*by, "s", "e", "label"]
    hit = gold.select(*keys).distinct().join(pred.select(*keys).distinct(), keys)
    count = lambda df, name: df.select(*keys).distinct().groupBy("label").agg(F.count("*").alias(name))
    out = count(gold, "n_gold").join(count(pred, "n_pred"), "label", "full_outer").join(count(hit, "tp"), "label", "left").na.fill(0)
    return scores(out)


def compare_lines(*files: DataFrame) -> DataFrame:
    """files(line_no, value) aligned by number: line_no, v0, v1, ... of the lines that differ or lack a partner."""
    out = files[0].select("line_no", F.col("value").alias("v0"))
    for k, f in enumerate(files[1:], 1):
        out = out.join(f.select("line_no", F.col("value").alias(f"v{k}")), "line_no", "full_outer")
    same = reduce(lambda a, b: a & b, [F.col("v0").eqNullSafe(F.col(f"v{k}")) for k in range(1, len(files))])
    return out.filter(~same)


def coref_agreement(a: DataFrame, b: DataFrame, files_a: DataFrame, files_b: DataFrame) -> DataFrame:
    """One row of agreement figures between two annotators' mentions(file, label, s, e), and their text files(file).

    A cluster's key is its last mention's start; clusters of a file with equal keys are compared by their spans.
    """

    def clusters(df: DataFrame) -> DataFrame:
        c = df.groupBy("file", "label").agg(F.max("s").alias("k"), F.min("s").alias("first"), F.collect_set(F.concat_ws("_", F.col("s").cast("string"), F.col("e").cast("string"))).alias("m"))
        return c.groupBy("file", "k").agg(F.max_by("m", F.struct("first", "label")).alias("m"))

    common = a.select("file").distinct().join(b.select("file").distinct(), "file")
    ca, cb = clusters(a).join(common, "file", "left_semi"), clusters(b).join(common, "file", "left_semi")
    both = ca.alias("a").join(cb.alias("b"), ["file", "k"], "full_outer")
    n1, n2, shared = F.size("a.m"), F.size("b.m"), F.size(F.array_intersect("a.m", "b.m"))
    pair = F.col("a.m").isNotNull() & F.col("b.m").isNotNull()
    out = both.agg(
        F.count("a.m").alias("clusters_1"), F.count("b.m").alias("clusters_2"), F.count_if(pair).alias("clusters_common"),
        F.count_if(pair & (n1 == n2) & (shared == n1)).alias("clusters_common_i"),
        *[F.coalesce(F.sum(F.when(pair, x)), F.lit(0)).alias(f"clusters_common_{n}") for n, x in (("w1", n1), ("w2", n2), ("wc", shared))],
    )
    counts = [df.select("file").distinct().withColumn("of", F.lit(n)) for n, df in (("files1", a), ("files2", b), ("files_common", common), ("filesr1", files_a), ("filesr2", files_b), ("filesr_common", files_a.select("file").intersect(files_b.select("file"))))]
    names = ["files1", "files2", "files_common", "filesr1", "filesr2", "filesr_common"]
    files = reduce(lambda x, y: x.unionByName(y), counts).agg(*[F.count_if(F.col("of") == n).alias(n) for n in names])
    return files.join(out, how="cross")  # both sides are one row


def with_files(runs: DataFrame, gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Files of a run that have gold annotations and a text."""
    return runs.join(gold.select("file").distinct(), "file", "left_semi").join(texts.select("file").distinct(), "file", "left_semi")


def stratified_split(spans: DataFrame, share: float = 0.1) -> DataFrame:
    """spans(doc, label, s, e) -> doc, part: dev takes documents, in hash order, until each label's mass has its share."""
    mass = spans.groupBy("doc", "label").agg(F.sum(F.col("e") - F.col("s")).alias("m"))
    w = Window.partitionBy("label")
    run = F.sum("m").over(w.orderBy(stable_number(F.col("doc")), "doc"))
    rows = mass.withColumns({"due": F.sum("m").over(w) * share, "before": run - F.col("m")})
    dev = rows.groupBy("doc").agg(F.every(F.col("before") < F.col("due")).alias("dev"))
    return dev.select("doc", F.when(F.col("dev"), "dev").otherwise("train").alias("part"))
