"""Storms: the batch form against a replay alert by alert, the stream against both, and hot scopes."""

import random
from collections import Counter, defaultdict

import pytest

from tidewatch import catalog
from tidewatch.operators import graph, storms
from tidewatch.plans.registry import Frames
from tidewatch.sources.alerts import ordinary, read_alerts

SF = "/root/testdata/sf0.001"
ALERTS = "scope_key string, inc string, event_id long, status string, severity string, message string, service string, alertname string, ingested_ms long, fired_ms long"


def frame(spark, rows):
    """Alerts (scope, inc, status, arrival in s[, fired in s]) in order of their ids."""
    full = [(s, inc, k, status, "high" if inc < "c" else "low", "m", inc, "x", int(at * 1000), int((fired[0] if fired else at) * 1000)) for k, (s, inc, status, at, *fired) in enumerate(rows)]
    return spark.createDataFrame(full, ALERTS)


def replayed(rows):
    scopes = defaultdict(storms.Replay)
    for r in sorted(rows, key=lambda r: (r.ingested_ms, r.event_id)):
        scopes[r.scope_key].step(r.inc, r.event_id, r.status, r.severity, r.ingested_ms, r.fired_ms)
    return scopes


def in_batch(df):
    from tidewatch.operators.incidents import incidents

    linked = storms.links(df, graph.observations(df))
    return {r.incident_id: (r.group_id, r.formed_ms, r.formed_event) for r in storms.storm_members(linked, incidents(df)).collect()}


def members(scopes):
    return {name: (group, *replay.groups[group]) for replay in scopes.values() for group, names in replay.members.items() for name in names}


def test_merge_keeps_the_oldest_group_and_its_anchor(spark):
    rows = []
    for k in range(3):
        rows += [("s", "c", "firing", 10 * k), ("s", "d", "firing", 10 * k + 1)]
    for k in range(3):  # a second pair, too late to meet the first
        rows += [("s", "a", "firing", 5000 + 10 * k), ("s", "b", "firing", 5001 + 10 * k)]
    for k in range(3):  # one incident meets both; e fired before all others
        rows += [("s", "b", "firing", 9000 + 10 * k), ("s", "c", "firing", 9001 + 10 * k), ("s", "e", "firing", 9002 + 10 * k, -50)]
    df = frame(spark, rows)
    got, scopes = in_batch(df), replayed(df.collect())
    assert got == members(scopes)
    assert {g for g, *_ in got.values()} == {"c"} and set(got) == set("abcde")


def test_batch_equals_replay(spark):
    r = random.Random(1)
    at, rows = 0.0, []
    for _ in range(400):
        at += r.choice([0, 1, 5, 60, 400])
        scope = r.choice("st")
        rows.append((scope, scope + r.choice("abcdefghij"), r.choice(["firing", "firing", "firing", "resolved"]), at, at - r.choice([0, 0, 3, 500])))
    df = frame(spark, rows)
    scopes = replayed(df.collect())
    weights = {(r.src, r.dst, r.scope_key): r.weight for r in graph.edges(graph.observations(df)).collect()}
    want = {(*edge, scope): w for scope, replay in scopes.items() for edge, (w, _) in replay.edges.items()}
    assert weights == pytest.approx(want)
    assert in_batch(df) == members(scopes)


def test_many_partners_are_ranked(spark):
    """More strong partners than an alert may join: which ones count changes with their weights."""
    r, rows = random.Random(4), []
    names = [f"n{k:02}" for k in range(60)]
    for k in range(600):
        rows.append(("s", r.choice(names), r.choice(["firing"] * 9 + ["resolved"]), k * 7))
    df = frame(spark, rows)
    assert in_batch(df) == members(replayed(df.collect()))


def test_a_storm_resolves_and_reopens(spark):
    from pyspark.sql import functions as F

    from tidewatch.functions import columns as C
    from tidewatch.operators.incidents import incidents

    rows = [("s", inc, "firing", 10 * k + j) for k in range(3) for j, inc in enumerate("ab")]
    rank = C.pick(F.col("severity"), C.PRIORITIES, 9)

    def facts(rows):
        df = frame(spark, rows)
        observed = graph.observations(df)
        found = incidents(df)
        return storms.storm_facts(storms.storm_members(storms.links(df, observed), found), found, graph.edges(observed), rank).collect()

    over = [*rows, ("s", "a", "resolved", 100), ("s", "b", "resolved", 101)]
    [done], [again] = facts(over), facts([*over, ("s", "b", "firing", 200)])
    assert (done.status, again.status) == ("RESOLVED", "OPEN")
    assert done.group_id == again.group_id == "a" and done.members == 2
    assert done.title == "a — x (+1 correlated)" and done.severity == "high" and done.root == "a"


def test_stream_equals_batch(spark, tmp_path):
    from tidewatch.streaming.lifecycle import stream_alerts
    from tidewatch.streaming.storms import stream_storms

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.read.parquet(f"{SF}/events.parquet")
        rows = [r.event_id for r in read_alerts(spark, SF).orderBy("ingested_ms", "event_id").select("event_id").collect()]
        folder = str(tmp_path / "in")
        for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):  # files in order of arrival
            events.filter(events.event_id.isin(part)).coalesce(1).write.mode("append").parquet(folder)
        seen = {}

        def take(df, batch):
            for r in df.collect():
                if r.gone:
                    seen.pop((r.scope_key, r.group_id), None)
                else:
                    seen[r.scope_key, r.group_id] = (r.formed_ms, r.formed_event, r.members)

        stream = stream_storms(stream_alerts(spark, folder, 1)).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = catalog.QUERIES["storm_members"](spark, SF).collect()
    count = Counter(r.group_id for r in found)
    assert {g: (*born[:2], count[g]) for (_, g), born in seen.items()} == {r.group_id: (r.formed_ms, r.formed_event, count[r.group_id]) for r in found}
    assert {g: born[2] for (_, g), born in seen.items()} == dict(count)
    assert members(replayed(ordinary(Frames(spark, SF).alerts()).collect())) == {r.incident_id: (r.group_id, r.formed_ms, r.formed_event) for r in found}


def test_a_hot_scope_is_many_small_groups(spark):
    """Sixty thousand alerts of one scope within a minute: no run of the fold holds more than its bound, and rows are those of a replay."""
    n, names = 60_000, 400
    df = spark.range(n).selectExpr("'s' AS scope_key", f"concat('n', (id * 7919) % {names}) AS inc", "id AS event_id", "IF(id % 50 = 0, 'resolved', 'firing') AS status", "'low' AS severity", "id AS ingested_ms", "id AS fired_ms")
    seen = graph.observations(df)
    per_alert = seen.groupBy("event_id").count()
    assert per_alert.agg({"count": "max"}).first()[0] == graph.NEIGHBOURS
    last, want = {}, {}
    for k in range(n):
        name = f"n{k * 7919 % names}"
        last.pop(name, None)
        if k % 50:
            last[name] = k
            if k % 997 == 0:
                want[k] = list(reversed(last))[:25]
    got = defaultdict(list)
    for r in seen.filter("event_id % 997 = 0").orderBy("event_id", "rk").collect():
        got[r.event_id].append(r.ni)
    assert got == want
