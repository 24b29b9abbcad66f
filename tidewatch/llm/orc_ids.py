"""Token ids in ORC files.

One file per shard, shards in ascending doc_id order and rows ascending within each. ORC keeps the ids in integer
run-length encoding (version 2), by stripes that readers take in parallel; row indexes and Bloom filters on doc_id let a
lookup skip stripes and row groups. Each row holds its document's ids with the end id, its place in its shard and the
number of ids before it there; the shards' totals, one row each, turn that into a place in the whole.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows with equal doc_id keep a
fixed order (by the text's hash); other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import slices, utf8
from .pretokens import coder

_BATCH_BYTES = 6 << 20
_SCHEMA = "shard int, row long, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_ids(docs: DataFrame, path: str, file: str, end_id: int = 1, shards: int = 0) -> None:
    """Encodes docs (doc_id, text) and writes the files of the token store at path."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, shard, row, start = coder(file), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in slices(offsets, _BATCH_BYTES):
                flat, bounds = library.encode_batch(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                n = high - low
                ids = np.insert(flat, bounds[1:], end_id).astype(np.int32)
                ends = bounds + np.arange(n + 1)
                counts = np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(row + np.arange(n)), batch.column("doc_id").slice(low, n), pa.array(start + ends[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))],
                    ["shard", "row", "doc_id", "local_start", "n_tokens", "ids"],
                )
                row += n
                start += int(ends[-1])

    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        sorted_docs.mapInArrow(run, _SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", 16 << 20)
        .option("orc.row.index.stride", 2000)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """shard, row, doc_id, local_start, n_tokens, ids; filters on doc_id skip stripes by statistics and Bloom filters."""
    return spark.read.schema(_SCHEMA).orc(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """shard, base: ids before each shard; a row per file, so that its window is small."""
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def ids_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            raw = memoryview(column.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("shard", "doc_id", "local_start", "n_tokens")), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "doc_id", "local_start", "n_tokens", "n_read", "ids_crc32"])

    store = read_ids(spark, path)
    read = store.select("shard", "doc_id", "local_start", "n_tokens", "ids").mapInArrow(run, "shard int, doc_id long, local_start long, n_tokens long, n_read long, ids_crc32 long")
    # a row per file: its size is the number of files, whatever they hold
    placed = read.join(F.broadcast(shard_starts(store)), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("local_start")).cast("long").alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")
