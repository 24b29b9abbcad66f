"""Lloyd's clustering in exact integers by deltas.

Each round is one job over the table that the round before left: vectors with their owner and their distance to it. A
vector whose owner stayed where it was knows that no other unmoved centroid is nearer, and is compared only with those
that moved; a vector whose owner moved is compared with all. A vector that changes its owner is a signed transfer: it is
taken from one sum and added to the other. Every task adds its transfers up and leaves a row for each centroid they touch;
the driver holds the global sums, k times dim integers, and adds the rounds' transfers to them. Rounds end early once
no centroid moves, which changes nothing.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; rows
repeat as they come; rows without an id are clustered but start no centroid; equal hashes are told apart by components;
with fewer vectors than k there are fewer centroids, with none there are no rows; components beyond 2 ** 27 as integers
raise OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Rounds, kept_vectors, summed, unpacked

STATE = "key long, x binary, owner int, distance long, centroid int, n long, sums array<long>"


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the lesser of equals) and squared distance of each vector; owner is -1 where there is none yet."""
    loose = (owner < 0) | moved[owner]
    best, least = np.where(loose, len(centroids), owner), np.where(loose, np.iinfo(np.int64).max, distance)
    for c, place in enumerate(centroids):
        rows = slice(None) if moved[c] else np.flatnonzero(loose)
        apart = x[rows] - place
        d = np.einsum("ij,ij->i", apart, apart)
        nearer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
        least[rows], best[rows] = np.where(nearer, d, least[rows]), np.where(nearer, c, best[rows])
    return best, least


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after one assignment, and the task's transfers: rows with centroid, n and sums alone."""
    k, dim = centroids.shape
    schema = pa.schema([("key", pa.int64()), ("x", pa.binary()), ("owner", pa.int32()), ("distance", pa.int64()), ("centroid", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def filled(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = unpacked(batch.column("x"), dim)
            before = batch.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
            owner, distance = reassigned(x, before, batch.column("distance").to_numpy(zero_copy_only=False).astype(np.int64), centroids, moved)
            went = owner != before
            came = went & (before >= 0)
            n += np.bincount(owner[went], minlength=k) - np.bincount(before[came], minlength=k)
            for c in range(k):
                sums[c] += x[went & (owner == c)].sum(0) - x[came & (before == c)].sum(0)
            yield filled(len(x), key=batch.column("key"), x=batch.column("x"), owner=pa.array(owner, pa.int32()), distance=pa.array(distance))
        touched = np.flatnonzero((n != 0) | (sums != 0).any(1))
        yield filled(len(touched), centroid=pa.array(touched, pa.int32()), n=pa.array(n[touched]), sums=pa.array(sums[touched].tolist(), pa.list_(pa.int64())))

    return state.select("key", "x", "owner", "distance").mapInArrow(run, STATE)


def first_centroids(vectors: DataFrame, k: int, dim: int, seed: str) -> np.ndarray:
    """The k vectors with the least sha256 of "seed:id", in that order."""
    hashed = vectors.filter("key is not null").select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256).alias("h"))
    rows = [r["x"] for r in hashed.orderBy("h", "x").limit(k).collect()]
    return unpacked(pa.array(rows, pa.binary()), dim) if rows else np.zeros((0, dim), np.int64)


def delta_lloyd(vectors: DataFrame, key: str, column: str, *, scale: int = 1024, dim: int = 64, k: int = 8, seed: str = "3", rounds: int = 10) -> tuple[DataFrame, np.ndarray]:
    """Vectors (key, x, owner, distance) after so many rounds and a last assignment, and the final centroids."""
    kept = kept_vectors(vectors, key, column, scale, dim)
    centroids = first_centroids(kept, k, dim, seed)
    state = kept.select("key", "x", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    if not len(centroids):
        return state.filter(F.lit(False)), centroids
    kept_rounds, moved = Rounds("delta-lloyd"), np.ones(len(centroids), bool)
    n, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    for left in range(rounds, -1, -1):
        table = kept_rounds.write(_round(state, centroids, moved))
        state = table.filter("centroid is null").select("key", "x", "owner", "distance")
        if not left:
            break
        for (c,), more, by in summed(table.filter("centroid is not null"), ["centroid"], dim):
            n[c] += more
            sums[c] = [s + b for s, b in zip(sums[c], by, strict=True)]
        after = np.array([[s // n[c] for s in sums[c]] if n[c] else centroids[c].tolist() for c in range(len(centroids))], np.int64)
        moved, centroids = (after != centroids).any(1), after
        if not moved.any():
            break
    return state, centroids


def cluster_report(vectors: DataFrame, key: str, column: str, **how: object) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    state, centroids = delta_lloyd(vectors, key, column, **how)
    by = {r["owner"]: int(r["d"]) for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("owner"))

    return state.select(
        F.col("key").alias(key),
        F.col("owner").alias("cluster"),
        "distance",
        of_cluster([by.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(by.values())).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )
