"""Co-occurrence weights as alerts stream in: observations from keyed state, weights from mergeable parts of micro-batches.

What a micro-batch observes is summed apart into (weight, time) parts, and a folder holds one set of parts for each batch.
A batch that is repeated writes its own set again, so it changes nothing; reading merges a key's parts in the order of the
batches, and compact() replaces all sets up to a batch by their merger.

Micro-batches have to arrive in order of ingest time, as that clock is ours; what the sources' clocks say may come late.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import graph as G
from ..operators.store import written
from ..sources.alerts import ordinary

SEEN = "event_id long, ct long, cf long, scope_key string, ci string, ni string, nf long, rk int"
#: What is weighed (an edge, a node, or a scope's rounds), of up to two incidents of a scope, and its part of a batch.
PARTS = "kind string, scope_key string, a string, b string, w double, span long, first_cf long, last_cf long, m long"
KEYS = ["kind", "scope_key", "a", "b"]


class Present(StatefulProcessor):
    """One scope's active incidents of the window, with when they arrived and had fired; what each alert finds there."""

    def __init__(self, window_ms: int, neighbours: int):
        self.window_ms, self.neighbours = window_ms, neighbours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.present = handle.getMapState("present", "name string", "at long, event long, fired long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.present.iterator()}
        present = dict(sorted(held.items(), key=lambda item: item[1][:2]))  # the latest comes last
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ingested_ms", "event_id"])
        out, at = [], 0
        for inc, event, status, at, fired in frame[["inc", "event_id", "status", "ingested_ms", "fired_ms"]].itertuples(index=False, name=None):
            present.pop(inc, None)
            if status == "resolved":
                continue
            present[inc] = (int(at), int(event), int(fired))
            for rank, name in enumerate(itertools.islice(reversed(present), self.neighbours), 1):
                seen, _, when = present[name]
                if seen < at - self.window_ms:
                    break
                out.append((event, at, fired, key[0], inc, name, when, rank))
        # what the window has left behind no later alert can find
        present = {name: entry for name, entry in present.items() if entry[0] >= at - self.window_ms}
        for name in held.keys() - present.keys():
            self.present.removeKey((name,))
        for name, entry in present.items():
            if held.get(name) != entry:
                self.present.updateValue((name,), entry)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEEN.split(", ")])

    def close(self) -> None:
        pass


def stream_observations(alerts: DataFrame, window_ms: int = G.WINDOW_MS, neighbours: int = G.NEIGHBOURS) -> DataFrame:
    """The rows of graph.observations() (without part), as alerts arrive. Needs the RocksDB state store.

    A scope's alerts of one micro-batch are one group, as who is active depends on all before.
    """
    rows = ordinary(alerts).select("scope_key", "inc", "event_id", "status", "ingested_ms", "fired_ms")
    return rows.groupBy("scope_key").transformWithStateInPandas(Present(window_ms, neighbours), SEEN, "Append", "None")


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    """All sets of parts that count: the latest compact one, and the batches after it; part is their place."""
    rows = spark.read.schema(PARTS).parquet(f"{folder}/sets/*/*").withColumn("__dir", F.split(F.col("_metadata.file_path"), "/"))
    rows = rows.withColumns({"part": F.element_at("__dir", -2).cast("long"), "compact": F.element_at("__dir", -3) == "upto"}).drop("__dir")
    done = _compacted(spark, folder)
    return rows.filter(F.when(F.col("compact"), F.col("part") == done).otherwise(F.col("part") > done)).drop("compact")


def _compacted(spark: SparkSession, folder: str) -> int:
    """The last batch that compact() has merged, or -1."""
    return spark.read.schema("batch long").parquet(f"{folder}/marks/*").agg(F.max("batch")).first()[0]


def _mark(spark: SparkSession, folder: str, batch: int, mode: str) -> None:
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode(mode).parquet(f"{folder}/marks/{batch}")


def weigher(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over stream_observations(): writes the parts of a batch, the same ones whenever it is repeated."""

    def weigh(observed: DataFrame, batch: int) -> None:
        _mark(observed.sparkSession, folder, -1, "ignore")
        # a scope's observations of a batch are cut by counted alerts, so that a hot one is no single group
        alerts = written(observed.select(*(c.split()[0] for c in SEEN.split(", "))), "observed")
        own = alerts.filter("ni = ci").select("scope_key", "ct", "event_id")
        part = F.floor((F.row_number().over(Window.partitionBy("scope_key", F.floor(F.col("ct") / G.BUCKET_MS)).orderBy("ct", "event_id")) - 1) / (G.RUN * G.PARTS))
        # parts are in order of arrival: the minute first, then the thousands of alerts within it
        own = own.select("event_id", (F.floor(F.col("ct") / G.BUCKET_MS) * (1 << 20) + part).alias("part"))
        seen = alerts.join(own, "event_id")
        nothing = F.lit("")
        kinds = [
            G.directed(seen).select(F.lit("edge").alias("kind"), "scope_key", F.col("src").alias("a"), F.col("dst").alias("b"), "ct", "event_id", "cf", "part"),
            seen.select(F.lit("node").alias("kind"), "scope_key", F.col("ni").alias("a"), nothing.alias("b"), "ct", "event_id", "cf", "part"),
            seen.filter("ni = ci").select(F.lit("scope").alias("kind"), "scope_key", nothing.alias("a"), nothing.alias("b"), "ct", "event_id", "cf", "part"),
        ]
        rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
        G.merged(G.partial(rows, KEYS), KEYS).select(*(c.split()[0] for c in PARTS.split(", "))).write.mode("overwrite").parquet(f"{folder}/sets/batches/{batch}")

    return weigh


def compact(spark: SparkSession, folder: str, batch: int) -> None:
    """Merges the sets up to batch into one, which counts by its last write; earlier sets may be deleted then. Not while one
    of these batches may still be repeated."""
    if batch > _compacted(spark, folder):
        G.merged(_sets(spark, folder).filter(F.col("part") <= batch), KEYS).select(*(c.split()[0] for c in PARTS.split(", "))).write.mode("overwrite").parquet(f"{folder}/sets/upto/{batch}")
        _mark(spark, folder, batch, "overwrite")


def _weights(spark: SparkSession, folder: str, kind: str, *named: Column) -> DataFrame:
    return G.merged(_sets(spark, folder).filter(F.col("kind") == kind), KEYS).select("scope_key", *named)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """As graph.edges(), of the batches so far."""
    return _weights(spark, folder, "edge", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"), F.col("last_cf").alias("last_seen_ms"), F.col("m").alias("n"))


def node_stats(spark: SparkSession, folder: str) -> DataFrame:
    """As graph.node_stats(), of the batches so far."""
    return _weights(spark, folder, "node", F.col("a").alias("node"), F.col("w").alias("observations"), F.col("last_cf").alias("last_observed_ms"))


def scope_stats(spark: SparkSession, folder: str) -> DataFrame:
    """As graph.scope_stats(), of the batches so far."""
    return _weights(spark, folder, "scope", F.col("w").alias("rounds"), F.col("last_cf").alias("last_observed_ms"), F.col("m").alias("observed_revision"))
