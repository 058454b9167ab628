"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids, stripe-parallel reads.

ORC's writer chooses run lengths, deltas or packed bits for the ids by itself; each stripe carries statistics
and, with the options below, a Bloom filter of doc_id for each row group. Files are range-partitioned and
sorted by doc_id, so a filter on it prunes whole stripes, and every stripe can be read by a task of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.llm import common as C
from ledgerleaf.llm.tokens import encoder

END_ID = 1
OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.encoding.strategy": "SPEED",
}


def _encode(path: str, end_id: int):
    def run(batches):
        C.at_work("op4")
        end, at = np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            blobs = [ids + end for ids in encoder(path).encode_batch(batch.column(1).to_pylist())]
            sizes = np.array([len(b) // 4 for b in blobs], np.int64)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            part = batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at + edge[:-1], pa.int64()), part, ids], names=["doc_id", "start_in_part", "part", "ids"])
            at += int(edge[-1])
        C.rested()

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write doc_id, start_in_part, part, ids and n_tokens under ``path`` in ascending doc_id order.

    A null text is empty and gives the end id alone; an empty table gives files without rows. Rows with a
    null doc_id sort first. Rows that repeat a doc_id are all written, side by side, in no given order. A very long text
    is one row. Other columns, whatever their names, are not written.
    """
    C.small_batches(docs.sparkSession, 1000)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"))
    parts = max(C.partitions(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism)
    ranged = slim.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id")
    ranged.mapInArrow(_encode(tokenizer, end_id), "doc_id long, start_in_part long, part int, ids array<int>").withColumn("n_tokens", F.size("ids").cast("long")).write.options(**OPTIONS).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids; a filter on doc_ids reaches stripes and Bloom filters."""
    rows = spark.read.schema("doc_id long, start_in_part long, part int, ids array<int>, n_tokens long").orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    # One row of two numbers for each file, and there are no more files than the writer had partitions: a proven bound.
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "ids")


def _digest(batches):
    for batch in batches:
        ids = batch.column(2)
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        edge = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edge), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.fresh_path(spark, "token-orc")
    write_token_orc(C.load(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_orc(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
