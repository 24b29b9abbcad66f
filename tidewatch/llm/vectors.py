"""Embedding columns as rows of exact integers, and the tables that rounds of a clustering leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import utf8
from .common import new_path

#: Integers beyond this could pass 64 bits as summed squares of differences, and raise.
LIMIT = 1 << 27


def integer_rows(column: pa.Array, scale: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which values are vectors of dim finite components, and those vectors' components as floor(scale * x)."""
    right = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim
    flat = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(flat).all(1)
    right[np.flatnonzero(right)] = finite
    numbers = np.floor(flat[finite] * scale)
    if len(numbers) and np.abs(numbers).max() > LIMIT:
        raise OverflowError(f"a component times {scale} is beyond {LIMIT}: distances would pass 64 bits")
    return right, numbers.astype(np.int64)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values of one width."""
    data = np.ascontiguousarray(rows)
    width = data.itemsize * data.shape[1]
    ends = np.arange(len(data) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def packed(numbers: np.ndarray) -> pa.Array:
    """Integers as binary values whose order of bytes is the order of the numbers."""
    return binary((numbers + (1 << 31)).astype(">u4"))


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return utf8(column)[0].view(">u4").astype(np.int64).reshape(-1, dim) - (1 << 31)


def kept_vectors(vectors: DataFrame, key: str, column: str, scale: int, dim: int, **also: str) -> DataFrame:
    """key (long), x (packed integers) and further columns (as strings, by name) of the rows whose vector has dim finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, numbers = integer_rows(batch.column("__vector"), scale, dim)
            rows = batch.filter(pa.array(right))
            yield pa.RecordBatch.from_arrays([rows.column(0), packed(numbers), *(rows.column(c) for c in also)], ["key", "x", *also])

    # a column that is no array of numbers fails here, before any task starts
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("__vector"), *(F.col(c).cast("string").alias(name) for name, c in also.items()))
    return rows.mapInArrow(run, ", ".join(["key long", "x binary", *(f"{c} string" for c in also)]))


class Rounds:
    """The tables of successive rounds in the shared folder: each is read by the next, and dropped once that is whole."""

    def __init__(self, what: str):
        self.what, self.path = what, None

    def write(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = new_path(spark, self.what)
        df.write.option("compression", "zstd").parquet(self.path)
        if before is not None:
            place = spark._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return spark.read.schema(df.schema).parquet(self.path)


def summed(rows: DataFrame, keys: list[str], dim: int) -> list[tuple[tuple, int, list[int]]]:
    """Keys, n and sums, added up over rows of (keys, n, sums): as many rows as there are entries of a codebook."""
    cells = rows.select(*keys, "n", F.posexplode("sums").alias("i", "s")).groupBy(*keys, "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    found: dict[tuple, tuple[int, list[int]]] = {}
    for row in cells.collect():
        found.setdefault(tuple(row[k] for k in keys), (row["n"], [0] * dim))[1][row["i"]] = int(row["s"])
    return [(key, n, sums) for key, (n, sums) in found.items()]
