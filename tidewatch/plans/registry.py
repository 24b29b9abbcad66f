"""How queries are registered: a function from (spark, sf_dir) and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph, incidents
from ..operators.store import written
from ..sources.alerts import ordinary, read_alerts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Frames:
    """The model's tables of one data directory, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of one query need: written once, to the shared folder."""
        if name not in self._kept:
            self._kept[name] = written(build(), name)
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def alerts(self) -> DataFrame:
        return read_alerts(self.spark, self.sf_dir)

    def o(self) -> DataFrame:
        return self._kept["ordinary"] if "ordinary" in self._kept else ordinary(self.alerts())

    def settled(self) -> DataFrame:
        """Ordinary alerts as a table: for what reads them more than twice, as deriving them costs more than writing them once."""
        return self.kept("ordinary", self.o)

    def incidents(self) -> DataFrame:
        return incidents.incidents(self.o())

    def observed(self) -> DataFrame:
        return graph.observations(self.settled())

    def edges(self) -> DataFrame:
        return graph.edges(self.observed())

    def nodes(self) -> DataFrame:
        return graph.node_stats(self.observed())

    def scopes(self) -> DataFrame:
        return graph.scope_stats(self.settled())

    def outbox(self) -> DataFrame:
        k, at = F.col("k"), F.col("ingested_ms")
        return self.o().select(
            F.col("event_id").alias("outbox_id"), F.col("inc").alias("incident_id"), F.element_at(F.array(*map(F.lit, ["slack", "pagerduty", "email"])), (F.col("event_id") % 3 + 1).cast("int")).alias("channel"),
            F.when(k % 4 == 0, "create").otherwise("update").alias("action"), F.when(k % 10 < 6, "pending").when(k % 10 == 6, "sent").when(k % 10 == 7, "dead").otherwise("superseded").alias("status"),
            (k % 6).alias("attempts"), C.pick(F.col("severity"), C.PRIORITIES, 2).alias("priority"), at.alias("created_ms"), (at + (k % 7) * 1000).alias("next_attempt_ms"),
            F.when(k % 5 == 0, at + 60000).alias("locked_until_ms"), F.when(k % 13 == 0, F.col("event_id") - 1).alias("failover_of"), F.when(k % 11 == 0, "pagerduty").alias("via"),
            F.when(k % 3 == 0, F.concat(F.lit("ref-"), (F.col("event_id") % 50).cast("string"))).alias("external_ref"),
            F.element_at(F.array(*map(F.lit, [200, 429, 401, 503, 404, 400])), (F.col("event_id") % 6 + 1).cast("int")).alias("http"), "k",
        )


def add(name: str, build: Callable[[Frames], DataFrame], oracle: str | None = None, ctes: str | None = None) -> None:
    """Registers a query; oracle is a SELECT over ctes."""
    QUERIES[name] = lambda spark, sf_dir: build(Frames(spark, sf_dir))
    if oracle is not None:
        ORACLE_SQL[name] = f"WITH {ctes}\n{oracle}" if ctes else oracle


def query(name: str, oracle: str | None = None, ctes: str | None = None) -> Callable:
    """Registers the decorated function of the model's tables under name."""

    def register(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        add(name, build, oracle, ctes)
        return build

    return register


def sql(name: str, spark_text: str, oracle: str, ctes: str | None, *tables: str) -> None:
    """Registers a query that is Spark SQL over model tables, named in braces."""

    def build(f: Frames) -> DataFrame:
        frames = {t: getattr(f, t)() if hasattr(f, t) else f.table(t) for t in tables}
        return f.spark.sql(spark_text, **frames)

    add(name, build, oracle, ctes)
