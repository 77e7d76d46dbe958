"""Task tables and streams: validation, order, dead letters, status, and case state across documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import queue

TASK = T.StructType([T.StructField(n, T.StringType()) for n in ("task_id", "caseid", "docid", "document", "type")] + [T.StructField("priority", T.IntegerType()), T.StructField("arrived", T.LongType())])
REQUIRED = ("caseid", "docid", "document")


def split_valid(tasks: DataFrame) -> DataFrame:
    """+ error: null for a task that can run. A document must be base64 text."""
    error = F.lit(None).cast("string")
    error = F.when(F.expr("try_to_binary(document, 'base64')").isNull(), "document is not base64").otherwise(error)
    for name in reversed(REQUIRED):
        error = F.when(F.coalesce(F.trim(F.col(name)), F.lit("")) == "", f"missing {name}").otherwise(error)
    return tasks.withColumn("error", error)


def open_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a result yet."""
    return tasks.join(done.select("task_id").distinct(), "task_id", "left_anti")


def statuses(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """task_id, status: SCHEDULED, RUNNING, DONE or ERROR."""
    r = results.groupBy("task_id").agg(F.max_by("state", "at").alias("state"))
    return tasks.select("task_id").join(r, "task_id", "left").withColumn("status", F.coalesce("state", F.lit("SCHEDULED"))).drop("state")


def run_batch(tasks: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(results, dead letters) of a batch: valid tasks, decoded and in order of the queue, through the steps."""
    checked = split_valid(tasks)
    good = queue(checked.filter("error is null")).withColumn("text", F.decode(F.unbase64("document"), "UTF-8")).drop("error", "document")
    for step in steps:
        good = step(good)
    return good, checked.filter("error is not null").select("task_id", "error")


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or none where nothing has been written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))
    return spark.read.parquet(path) if found else None


def _unwritten(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    done = _written(spark, path)
    return rows if done is None else open_tasks(rows, done)


def start(spark: SparkSession, folder: str, out: str, steps: list[Callable[[DataFrame], DataFrame]], trigger: dict | None = None):
    """Polls a folder of JSON tasks. Results, dead letters and states each skip the tasks they already hold, so a replay
    of a batch that failed anywhere writes nothing twice."""
    source = spark.readStream.schema(TASK).json(folder)

    def batch(tasks: DataFrame, number: int) -> None:
        tasks = _unwritten(tasks.dropDuplicates(["task_id"]), spark, f"{out}/done")
        state = lambda rows, name: rows.select("task_id", F.lit(name).alias("state"), F.lit(number).cast("long").alias("batch"))
        _unwritten(state(tasks, "RUNNING"), spark, f"{out}/running").write.mode("append").parquet(f"{out}/running")
        good, bad = run_batch(tasks, steps)
        _unwritten(bad, spark, f"{out}/errors").write.mode("append").parquet(f"{out}/errors")
        good.write.mode("append").parquet(f"{out}/done")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(**(trigger or {"processingTime": "1 second"})).start()


def states(spark: SparkSession, out: str) -> DataFrame:
    """task_id, state, at of what ``start`` has written, as ``statuses`` takes it."""
    parts = [(f"{out}/running", "RUNNING", 0), (f"{out}/errors", "ERROR", 1), (f"{out}/done", "DONE", 2)]
    rows = spark.createDataFrame([], "task_id string, state string, at int")
    for path, name, at in parts:
        if (found := _written(spark, path)) is not None:
            rows = rows.unionByName(found.select("task_id", F.lit(name).alias("state"), F.lit(at).alias("at")))
    return rows


def stream_case_ids(mentions: DataFrame) -> DataFrame:
    """A stream of mentions(case_id, doc_id, pos, type, text) -> case_id, text, ent_id of the new texts of each batch.

    The state of a case is its map from text to identifier. Within a batch mentions count in order of document and place,
    so batches that arrive in that order give the same map as ``encode.allocate``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["doc_id", "pos"], kind="stable")
        new = []
        for kind, text in zip(rows["type"], rows["text"], strict=True):
            if text not in known:
                known[text] = f"#{kind}{len(known) + 1}"
                new.append((key[0], text, known[text]))
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(new, columns=["case_id", "text", "ent_id"])

    kind = dict(mentions.dtypes)["case_id"]
    return mentions.groupBy("case_id").applyInPandasWithState(step, f"case_id {kind}, text string, ent_id string", "texts array<string>, ids array<string>", "append", "NoTimeout")
