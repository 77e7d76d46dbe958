"""Token-id datasets in ascending doc_id order, written as grammar shards (operator 1).

``write_tokens`` range-partitions by doc_id, encodes with the tokenizers library, appends the end id to each document and
writes shards of about ``shard_ids`` ids as binary rows of a Parquet table in the shared folder; Spark's commit protocol
makes it safe against lost executors. ``read_tokens`` decodes the stored shards.

Defined cases: a null text is empty (only the end id); null doc_ids come first; equal doc_ids are ordered by text; a
document is never cut, so a shard ends with the first document that fills it; an empty table writes no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import keep_memory, release_memory
from .grammar import Shard, pack

_SCHEMA = "part int, shard int, n_ids long, n_docs long, payload binary"


def write_tokens(df: DataFrame, tokenizer: str, path: str, *, end_id: int = 1, shard_ids: int = 3_000_000, memo: int = 400_000) -> None:
    """df(doc_id, text) -> the shard table at path."""

    def run(batches):
        keep_memory()
        enc, part, number = encoder(tokenizer, memo), TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[bytes] = []
        end = np.uint32(end_id).astype("<u4").tobytes()
        size = 0

        def shard():
            nonlocal docs, held, size, number
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            valid = np.array([d is not None for d in docs])
            raw = pack(np.array([d or 0 for d in docs], np.int64), valid, lengths, ids, enc.vocab_size)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([raw], pa.binary())], ["part", "shard", "n_ids", "n_docs", "payload"])
            docs, held, size, number = [], [], 0, number + 1
            return out

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_raw(b.column(1).to_pylist()), strict=True):
                docs.append(doc)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= shard_ids:
                    yield shard()
        if docs:
            yield shard()
        release_memory("encoders")

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The stored dataset: doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (little-endian unsigned 32 bit)."""
    table = spark.read.schema(_SCHEMA).parquet(path)
    # ids before each shard: within a part by a window over its shards, across parts over one row per part
    shards = table.select("part", "shard", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("shard")
    begin = shards.select("part", "shard", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("inner_start")).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inner_start")).alias("shard_start"))

    kept = ["ids"] if with_ids else []

    def run(batches):
        for b in batches:
            for part, shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Shard(raw.as_py())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                view = memoryview(ids.tobytes())
                own = [view[4 * (e - n) : 4 * e] for n, e in zip(s.lengths.tolist(), ends.tolist(), strict=True)]
                step = 2000
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    stored = [pa.array([bytes(x) for x in some], pa.binary())] if with_ids else []
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(some), pa.int32()), pa.array([shard] * len(some), pa.int32()), pa.array(s.doc_ids[k : k + step], pa.int64(), mask=~s.valid[k : k + step]),
                            pa.array((ends - s.lengths)[k : k + step], pa.int64()), pa.array(s.lengths[k : k + step], pa.int64()), pa.array([zlib.crc32(x) for x in some], pa.int64()), *stored,
                        ],
                        ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32", *kept],
                    )

    docs = table.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return docs.join(begin, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *kept)
