"""Shared pieces of the training-data operators: work tables and row selection."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, and its complement as a pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none (tests) is a local one set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("veilgrid.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"veilgrid-{uuid.uuid4().hex[:12]}")
        spark.conf.set("veilgrid.work.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilgrid/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: this cuts lineage, fixes row ids and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A 128-bit key of a text; equal texts have equal keys. Null: the empty text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


#: What operators keep in a worker process between tasks.
KEPT: dict[str, dict] = {}


def release_memory(keep: str = "") -> None:
    """Give freed memory of a worker process back: workers outlive tasks and share their executor's memory.

    What other operators than ``keep`` have kept goes too, so that the steps of a long job do not add up.
    """
    import ctypes
    import gc

    import pyarrow as pa

    for name, kept in KEPT.items():
        if name != keep:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def keep_memory() -> None:
    """Let large arrays be reused from the heap instead of being mapped anew, until ``release_memory`` gives them back."""
    import ctypes

    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
