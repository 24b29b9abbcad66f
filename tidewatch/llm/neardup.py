"""Near-duplicates by MinHash bands with sequential Bayesian verification.

1. Every text's set of hashed shingles gives its size, a 128-bit fingerprint and a MinHash signature. Texts with equal
   sets form a class; only one of each class goes on.
2. Signatures fall into buckets by bands. Every member of a bucket is compared with the bucket's least member only, so
   candidates stay linear in the members, however large a bucket is.
3. Candidates are verified in sequence: batches of signature places are compared, and a pair goes once the posterior
   probability of a similarity at the threshold, or above, falls under a chosen miss probability. Survivors are
   confirmed on their full shingle sets, as sets of 64-bit hashes of all shingles; confirmed links give components.
4. Buckets whose members then lie in several components may hold more links. Their members meet block by block (blocks of
   bounded size, each pair of blocks a group of its own), leave out pairs of one component and pairs that met in an
   earlier band, and what the posterior leaves is confirmed there and then. No bucket is capped.

With 25 bands of 5 a pair at similarity 0.85 misses all bands with probability 8e-7, a pair above still less; at 0.8,
which the corpus pipeline asks for, with probability 5e-5.

Defined results: texts without words have an empty set and link with nothing; rows that share a doc_id share its
component; rows without a doc_id link with nothing; rows repeat as they come; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, utf8
from .common import join_spread, written
from .components import components
from .shingles import mixed, shingle_sets

BANDS, ROWS, PLACES, STEP, BLOCK = 25, 5, 128, 16, 1024
_BATCH_BYTES = 4 << 20
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sig (PLACES unsigned 32-bit integers, null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in slices(offsets, _BATCH_BYTES):
                key, begins = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                n = np.diff(begins)
                filled = np.flatnonzero(n)
                first = begins[:-1][filled]
                sums = np.zeros((2, high - low), np.uint64)
                signature = np.zeros((len(filled), PLACES), np.uint32)
                if len(filled):
                    sums[0, filled] = np.add.reduceat(mixed(key), first)
                    sums[1, filled] = np.add.reduceat(mixed(key ^ np.uint64(0x5851F42D4C957F2D)), first)
                    for i, factor in enumerate(_FACTORS):
                        signature[:, i] = np.minimum.reduceat(((key * factor) >> np.uint64(32)).astype(np.uint32), first)
                column: list[bytes | None] = [None] * (high - low)
                for k, d in enumerate(filled):
                    column[d] = signature[k].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(column, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each signature's each band."""
    keys = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key ^ signature[:, b * ROWS + r].astype(np.uint64))
        keys[:, b] = key
    return keys


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node: a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, PLACES)
            keys = _band_keys(signature).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, node long")


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of compared batches, the fewest equal places at which the posterior of similarity >= threshold (uniform prior) is still over miss."""

    def posterior(k: int, n: int) -> float:
        # the tail of Beta(k + 1, n - k + 1) above the threshold is a binomial sum
        return math.fsum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(k + 1))

    return [next(k for k in range(n + 1) if posterior(k, n) > miss) for n in range(STEP, PLACES + 1, STEP)]


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signatures (rows of a and b) the sequential test leaves."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, bound in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[equal[alive] >= bound]
        if not len(alive):
            break
    return alive


def _probable(pairs: DataFrame, nodes: DataFrame, least: list[int]) -> DataFrame:
    """The pairs (a, b) that pass the sequential test on their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, PLACES) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).take(pa.array(surviving(a, b, least)))

    sigs = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    others = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(sigs, "a").join(others, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, text of the nodes that share a bucket. Merged at every size: the nodes grow with the data."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets (of distinct hashes) have 100 * intersection >= percent * union."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [utf8(batch.column(c)) for c in ("text_a", "text_b")]
            good = []
            for low, high in slices(sides[0][1] + sides[1][1], _BATCH_BYTES):
                (ka, ba), (kb, bb) = (shingle_sets(d[o[low] : o[high]], o[low : high + 1] - o[low]) for d, o in sides)
                good += [low + k for k in range(high - low) if _alike(ka[ba[k] : ba[k + 1]], kb[bb[k] : bb[k + 1]], percent)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    first, second = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _within_blocks(members: DataFrame, least: list[int], percent: int) -> DataFrame:
    """members: bucket, node, comp, sig, text, size of mixed buckets. Confirmed links (a, b) between components, no more than members.

    Each pair is looked at in its first common band. What a task has linked already needs no further link.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def compare(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        signature = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, PLACES)
        keys = _band_keys(signature).view(np.int64)
        bucket, lo, block = table.column("bucket")[0].as_py(), table.column("lo")[0].as_py(), table.column("block").to_numpy()
        one = lo == table.column("hi")[0].as_py()
        band = int(np.flatnonzero(keys[0] == bucket)[0])
        data, offsets = utf8(table.column("text"))
        parts = [shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]) for x, y in slices(offsets, _BATCH_BYTES)]
        sets = [key[begins[k] : begins[k + 1]] for key, begins in parts for k in range(len(begins) - 1)]
        sizes = np.array([len(s) for s in sets])
        label = np.unique(comp, return_inverse=True)[1]
        links: list[tuple[int, int]] = []
        for i in range(len(node)):
            if not one and block[i] != lo:
                continue
            ok = (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            mates = np.flatnonzero(ok & (node > node[i]) if one else ok & (block != lo))
            if band and len(mates):
                mates = mates[~(keys[mates, :band] == keys[i, :band]).any(1)]
            if not len(mates):
                continue
            for j in mates[surviving(np.broadcast_to(signature[i], (len(mates), PLACES)), signature[mates], least)]:
                if label[j] != label[i] and _alike(sets[i], sets[j], percent):
                    links.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return meets.select("bucket", "node", "comp", "sig", "text", "block", "lo", "hi").groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-9) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    described = written(describe(docs), "described")
    least = least_matches(percent / 100, miss)
    filled = described.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.min_by("sig", "doc_id").alias("sig"))
    classes = written(classes, "classes")

    buckets = written(_buckets(classes), "buckets")
    hubs = written(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "hubs")
    members = written(join_spread(buckets, hubs, ["bucket"], "size", ["node"]), "members")
    pairs = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    texts = written(_texts(docs, members), "texts")
    links = _confirmed(written(_probable(pairs, classes, least), "probable"), texts, percent)
    # rows that share a doc_id but not their set link their classes
    same_id = filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    shared = filled.join(same_id, "doc_id", "left_semi").select("f1", "f2", "n_shingles", "doc_id").join(classes.select("f1", "f2", "n_shingles", "node"), ["f1", "f2", "n_shingles"])
    first = written(components(links.unionByName(shared.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))), "components")

    # buckets of more than one component
    placed = members.join(first, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    mixed_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("bucket")
    # the hub has met all the others
    rest = placed.filter("node <> hub and size > 2").join(mixed_buckets.hint("merge"), "bucket", "left_semi").select("bucket", "node", "comp", "size")
    rest = rest.join(classes.select("node", "sig").hint("merge"), "node").join(texts.hint("merge"), "node")
    late = written(_within_blocks(rest, least, percent), "late")
    comp_of = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    joined = late.join(comp_of("a"), "a", "left").join(comp_of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    second = components(joined).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    final = classes.select("f1", "f2", "n_shingles", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node")).join(second, "component", "left")
    final = final.select("f1", "f2", F.col("n_shingles").alias("__n"), F.coalesce("merged", "component").alias("component_id"))

    out = described.select("doc_id", "n_shingles", F.col("f1").alias("g1"), F.col("f2").alias("g2")).join(final, (F.col("g1") == F.col("f1")) & (F.col("g2") == F.col("f2")) & (F.col("n_shingles") == F.col("__n")), "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
