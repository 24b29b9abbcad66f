"""Weights of streamed alerts against those of the whole history, with repeated and merged batches."""

import pytest

from tidewatch.operators import graph
from tidewatch.plans.registry import Frames
from tidewatch.sources.alerts import read_alerts
from tidewatch.streaming import weights as W
from tidewatch.streaming.lifecycle import stream_alerts

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """The folder of parts, and what each of three batches observed."""
    at = tmp_path_factory.mktemp("weights")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    events = spark.read.parquet(f"{SF}/events.parquet")
    ids = [r.event_id for r in read_alerts(spark, SF).orderBy("ingested_ms", "event_id").select("event_id").collect()]
    for k in range(3):  # files in order of arrival; sources' times go back and forth between them
        events.filter(events.event_id.isin(ids[k * len(ids) // 3 : (k + 1) * len(ids) // 3])).coalesce(1).write.mode("append").parquet(str(at / "in"))
    folder, batches = str(at / "out"), {}
    weigh = W.weigher(folder)

    def take(df, batch):
        weigh(df, batch)
        batches[batch] = df.sparkSession.createDataFrame(df.toPandas(), W.SEEN)

    try:
        W.stream_observations(stream_alerts(spark, str(at / "in"), 1)).writeStream.foreachBatch(take).option("checkpointLocation", str(at / "at")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return folder, batches


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in sorted(set(df.columns) - set(keys))) for r in df.collect()}


def same(got, wanted):
    assert got.keys() == wanted.keys()
    for key, values in wanted.items():
        assert got[key] == pytest.approx(values, rel=1e-9), key


def everything(spark, folder):
    return rows_of(W.edges(spark, folder), "scope_key", "src", "dst"), rows_of(W.node_stats(spark, folder), "scope_key", "node"), rows_of(W.scope_stats(spark, folder), "scope_key")


def test_stream_equals_batch_also_when_repeated_or_merged(spark, streamed):
    folder, batches = streamed
    f = Frames(spark, SF)
    f.settled()
    observed = f.kept("observed", f.observed)
    late = observed.filter("ni = ci").selectExpr("cf", "lag(cf) OVER (PARTITION BY scope_key ORDER BY ct, event_id) > cf AS late").filter("late").count()
    assert len(batches) == 3 and late > 50
    seen = sorted(tuple(r) for b in batches.values() for r in b.collect())
    assert seen == sorted(tuple(r) for r in observed.drop("part").select(*batches[0].columns).collect())
    wanted = rows_of(graph.edges(observed), "scope_key", "src", "dst"), rows_of(graph.node_stats(observed), "scope_key", "node"), rows_of(f.scopes(), "scope_key")
    assert all(len(w) > 1 for w in wanted)
    for got, want in zip(everything(spark, folder), wanted, strict=True):
        same(got, want)
    W.weigher(folder)(batches[1], 1)  # a batch comes again
    W.compact(spark, folder, 1)
    W.compact(spark, folder, 1)
    for got, want in zip(everything(spark, folder), wanted, strict=True):
        same(got, want)
    W.compact(spark, folder, 2)
    for got, want in zip(everything(spark, folder), wanted, strict=True):
        same(got, want)


def test_a_merger_that_broke_off_does_not_count(spark, streamed):
    folder, batches = streamed
    before = everything(spark, folder)
    W.weigher(folder)(batches[0].limit(0), 3)  # a batch without alerts
    W.edges(spark, folder).limit(0).selectExpr("'edge' AS kind", "scope_key", "src AS a", "dst AS b", "weight AS w", "0L AS span", "0L AS first_cf", "0L AS last_cf", "0L AS m").write.parquet(f"{folder}/sets/upto/9")
    assert everything(spark, folder) == before


def test_parts_merge_in_any_grouping(spark):
    rows = spark.range(60).selectExpr("'s' AS k", "id AS event_id", "id * 1000 AS ct", "id * 7919 % 5003 * 3000 AS cf", "id div 10 AS part")
    keys = ["k"]
    whole = graph.merged(graph.partial(rows.withColumn("part", rows.part * 0), keys), keys).first()
    parts = graph.partial(rows, keys)
    halves = [graph.merged(parts.filter(f"part div 3 = {h}"), keys).selectExpr("*", f"{h}L AS part") for h in (0, 1)]
    for got in (graph.merged(parts, keys).first(), graph.merged(halves[0].unionByName(halves[1]), keys).first()):
        assert got.k == whole.k and got.w == pytest.approx(whole.w, rel=1e-12) and (got.span, got.first_cf, got.last_cf, got.m) == (whole.span, whole.first_cf, whole.last_cf, whole.m)
