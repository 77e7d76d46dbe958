"""What surrounds a sequence model: windows, features, merging of window labels. The model itself is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(pieces: DataFrame, size: int, stride: int) -> DataFrame:
    """pieces(doc_id, pieces: array) -> doc_id, win, begin, pieces: windows of ``size`` every ``stride``, until the end is in one."""
    last = F.greatest(F.size("pieces") - size, F.lit(0))
    begins = F.when(last > 0, F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(F.ceil(last / stride).cast("int") * stride))).otherwise(F.array(F.lit(0)))
    rows = pieces.filter(F.size("pieces") > 0).select("doc_id", "pieces", F.posexplode(begins).alias("win", "begin"))
    return rows.select("doc_id", "win", "begin", F.slice("pieces", F.col("begin") + 1, F.lit(size)).alias("pieces"))


def overlapping(pieces: DataFrame, size: int, overlap: int = 20) -> DataFrame:
    return windows(pieces, size, size - overlap)


def has_entity(labels: Column) -> Column:
    """Training windows without any entity are left out."""
    return F.exists(labels, lambda x: x != "O")


def features(words: DataFrame, size: int, pad: int = 1, ignore: int = -100) -> DataFrame:
    """words(doc_id, ids: array<array<int>>, labels: array<int>) -> fixed-length input_ids, input_mask, label_ids, valid.

    The first piece of a word carries its label; other pieces and the padding are ignored.
    """
    ids = F.slice(F.flatten("ids"), F.lit(1), F.lit(size))
    valid = F.slice(F.flatten(F.transform("ids", lambda w: F.transform(w, lambda _, k: (k == 0).cast("int")))), F.lit(1), F.lit(size))
    labels = F.slice(F.flatten(F.zip_with("ids", "labels", lambda w, one: F.transform(w, lambda _, k: F.when(k == 0, one).otherwise(ignore)))), F.lit(1), F.lit(size))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(size) - F.size(c)))
    return words.select("doc_id", fill(ids, pad).alias("input_ids"), fill(F.transform(ids, lambda _: F.lit(1)), 0).alias("input_mask"), fill(labels, ignore).alias("label_ids"), fill(valid, 0).alias("valid"))


def merge_windows(found: DataFrame) -> DataFrame:
    """found(doc_id, pos, label, p) from overlapping windows -> doc_id, pos, label, p: the label of largest mean probability."""
    mean = found.groupBy("doc_id", "pos", "label").agg(F.avg("p").alias("p"))
    best = mean.groupBy("doc_id", "pos").agg(F.max_by(F.struct("label", "p"), F.struct(F.round("p", 12), "label")).alias("b"))
    return best.select("doc_id", "pos", "b.label", "b.p")


def first_window(found: DataFrame) -> DataFrame:
    """found(doc_id, pos, win, label) -> the label of the first window that covers a row."""
    return found.groupBy("doc_id", "pos").agg(F.min_by("label", "win").alias("label"))


def best_label(scores: Column, labels: list[str]) -> Column:
    """The label of the largest of an array of scores; the first on ties."""
    at = F.array_position(scores, F.array_max(scores))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), at.cast("int"))


def log_softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    total = F.log(F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    return F.transform(scores, lambda x: x - top - total)


def tag(tokens: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """tokens(doc_id, sent_id, pos, form) + ner from a model: ``load`` runs once per worker and gives what takes a batch of
    sentences (lists of forms) to their lists of labels."""
    sentences = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("t"))

    def run(parts):
        model = load_once(load)
        for p in parts:
            yield p.assign(n=model([[t["form"] for t in x] for x in p["t"]]))

    labelled = sentences.mapInPandas(run, "doc_id string, sent_id int, t array<struct<pos: int, form: string>>, n array<string>".replace("doc_id string", f"doc_id {dict(tokens.dtypes)['doc_id']}").replace("sent_id int", f"sent_id {dict(tokens.dtypes)['sent_id']}"))
    rows = labelled.select("doc_id", "sent_id", F.explode(F.arrays_zip("t", "n")).alias("x")).select("doc_id", "sent_id", F.col("x.t.pos").alias("pos"), F.col("x.n").alias("ner"))
    return tokens.drop("ner").join(rows, ["doc_id", "sent_id", "pos"])


_LOADED: dict = {}


def load_once(load: Callable[[], Callable]) -> Callable:
    """The model of this worker process."""
    key = getattr(load, "__qualname__", repr(load))
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]
