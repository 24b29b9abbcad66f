"""Folds, graph and chain on small cases and against plain Python."""

import math
from collections import defaultdict

import pytest

from tidewatch import catalog
from tidewatch.operators import folds, graph
from tidewatch.operators.folds import breaker_step, lifecycle_step

SF = "/root/testdata/sf0.001"


def test_lifecycle_step_reopens_and_damps():
    state = lifecycle_step(None, "firing", 0)
    assert state["state"] == "ACKNOWLEDGED"
    cards, now = 1, 0
    for _ in range(10):
        for status in ("resolved", "firing"):
            now += 1000
            state = lifecycle_step(state, status, now)
            cards += state["notify"]
    assert state["reopen_count"] == 10 and state["state"] == "ACKNOWLEDGED" and cards < 10


def test_breaker_opens_probes_and_closes():
    state = {"state": "CLOSED", "failures": 0, "step": 0, "opened": None, "probe": None}
    for kind in ("message_fatal", "channel_down", "transient", "channel_down"):
        state = breaker_step(state, kind, 0)
    assert state["state"] == "CLOSED" and state["failures"] == 2
    state = breaker_step(state, "channel_down", 1000)
    assert state["state"] == "OPEN" and state["probe"] == 6000
    state = breaker_step(breaker_step(state, "probe_fail", 6000), "probe_ok", 20000)
    assert state["state"] == "HALF_OPEN" and state["step"] == 1
    assert breaker_step(state, "channel_down", 21000)["step"] == 2
    assert breaker_step(state, "ok", 21000)["state"] == "CLOSED"


EDGES = "src string, dst string, scope_key string, weight double, last_seen_ms long, n long"
CASES = [
    ([("noisy", "a", 10.0), ("a", "noisy", 10.0), ("noisy", "b", 10.0), ("b", "noisy", 10.0), ("cause", "x", 6.0), ("cause", "y", 6.0)], "cause"),
    ([("a", "b", 1.0)], None),
    ([("a", "b", 5.0)], "a"),
    ([(a, b, 8.0) for a in "abcd" for b in "abcd" if a != b], None),
]


@pytest.mark.parametrize("edges,leader", CASES)
def test_root_cause_verdicts(spark, edges, leader):
    table = spark.createDataFrame([(a, b, "s", w, 0, 1) for a, b, w in edges], EDGES)
    found = [r.leader for r in graph.root_cause(graph.node_lead(table, None, None)).collect()]
    assert found == ([leader] if leader else [])


def test_components_of_a_chain_and_a_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == dict.fromkeys("abcd", "a") | dict.fromkeys("xyz", "x")


def test_edges_equal_a_sequential_fold(spark):
    from tidewatch.sources.alerts import ordinary, read_alerts

    alerts = ordinary(read_alerts(spark, SF))
    rows = sorted(alerts.select("ingested_ms", "event_id", "fired_ms", "scope_key", "inc", "status").collect())
    assert any(a.fired_ms > b.fired_ms for a, b in zip(rows, rows[1:], strict=False))  # some arrive late
    last, weights = {}, {}
    for now, _, t, scope, inc, status in rows:
        last[inc] = (now, t, scope, status)
        order = [k for k in last if k != inc] + [inc]
        last = {k: last[k] for k in order}
        if status == "resolved":
            continue
        live = [k for k in reversed(order) if last[k][2] == scope and last[k][0] >= now - 900_000 and last[k][3] != "resolved"][:25]
        for k in live:
            if k != inc:
                pair = (k, inc) if last[k][1] <= t else (inc, k)
                w, at = weights.get(pair, (0.0, t))
                weights[pair] = (w * math.exp(-math.log(2) * max(0, t - at) / 3_600_000) + 1, t)
    got = {(r.src, r.dst): r.weight for r in graph.edges(graph.observations(alerts)).collect()}
    assert got.keys() == weights.keys()
    assert all(abs(got[k] - w) < 1e-6 for k, (w, _) in weights.items())


ALERT = "scope_key string, inc string, service string, alertname string, severity string, message string, event_id long, fired_ms long, ingested_ms long, status string"


def alerts_of(spark, rows):
    """(incident, event, fired, ingested, status) as alerts of one scope."""
    return spark.createDataFrame([("s", i, i, "x", "high", "m", e, f, t, st) for i, e, f, t, st in rows], ALERT)


def test_late_alerts_have_gap_0_and_neighbours_follow_arrival(spark):
    from tidewatch.operators import incidents

    base = 1_700_000_000_000
    rows = alerts_of(spark, [("a", 1, base + 1000, base + 1000, "firing"), ("a", 2, base + 500, base + 2000, "firing"), ("a", 3, base + 1500, base + 3000, "firing"), ("b", 4, base - 2_000_000, base + 4000, "firing"), ("c", 5, base + 5000, base + 1_000_000, "firing")])
    assert {r.event_id: r.gap for r in incidents.gaps(rows).collect()} == {1: None, 2: 0, 3: 1000, 4: None, 5: None}
    one = {r.incident_id: r for r in incidents.incidents(rows).collect()}["a"]
    assert (one.alert_count, one.first_alert_ms, one.last_alert_ms, one.last_ingested_ms) == (3, base + 1000, base + 1500, base + 3000)
    # b fired long ago on its own clock but arrives among a's alerts: they meet, and b leads; c arrives too late for both
    got = {(r.src, r.dst): r.weight for r in graph.edges(graph.observations(rows)).collect()}
    assert got == {("a", "b"): 1.0} or got == {("b", "a"): 1.0}
    assert ("a", "b") not in got  # a fired after b


def test_final_rhythm_equals_the_fold_and_the_prefixes(spark):
    import random

    import numpy as np

    from tidewatch.operators import incidents, prefixes
    from tidewatch.streaming.lifecycle import paced

    r, rows, gaps, event = random.Random(3), [], defaultdict(list), 0
    for inc, n in [("one", 1), ("two", 2), ("three", 3), ("many", 400)]:
        fired = now = 1_700_000_000_000
        for k in range(n):
            event += 1
            step = r.randint(-5000, 90_000) if k else 0
            now += r.randint(1, 100_000)
            fired += step
            rows.append((inc, event, fired, now, "firing"))
            if k:
                gaps[inc].append(float(max(0, step)))
    table = alerts_of(spark, rows)
    for x in incidents.incidents(table).collect():
        mean, variance = paced(gaps[x.incident_id])
        assert math.isclose(x.mean_gap, mean, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(x.variance, variance, rel_tol=1e-9, abs_tol=1e-6), x
    means, variances = prefixes.refolded(np.array(gaps["many"]))
    assert all((means[k], variances[k]) == paced(gaps["many"][: k + 1]) for k in range(0, 399, 13))
    place = defaultdict(int)
    for x in incidents.rhythm(table).orderBy("inc", "ingested_ms").collect():
        mean, variance = paced(gaps[x.inc][: place[x.inc]]) if place[x.inc] else (0.0, 0.0)
        assert math.isclose(x.mean_ms, mean, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(x.variance, variance, rel_tol=1e-9, abs_tol=1e-6), x
        place[x.inc] += 1


def test_prefixes_in_linear_time_equal_the_fold():
    import time

    import numpy as np

    from tidewatch.operators.prefixes import Prefixes, refolded

    rng = np.random.default_rng(5)
    spread = np.floor(rng.exponential(60_000, 5000))
    histories = {"spread": spread, "even": np.full(2000, 777.0), "jump": np.repeat([10.0, 1e7, 3.0], 1500), "first": np.append(1e9, spread // 10_000), "none": np.zeros(600), "empty": np.empty(0)}
    for name, gaps in histories.items():
        prefixes, parts, at = Prefixes(), [], 0
        while at < len(gaps):
            step = int(rng.integers(1, 900))
            parts.append(np.stack(prefixes.take(gaps[at : at + step])))
            at += step
        mean, variance = np.concatenate(parts, axis=1) if parts else np.empty((2, 0))
        means, variances = refolded(gaps)
        assert np.allclose(mean, means, rtol=1e-9, atol=1e-9) and np.allclose(variance, variances, rtol=1e-9, atol=1e-9), name
    # a million alerts of one incident
    long, began, prefixes = np.floor(rng.exponential(60_000, 1_000_000)), time.time(), Prefixes()
    found = [np.stack(prefixes.take(long[k : k + 10_000]))[:, -1] for k in range(0, len(long), 10_000)]
    assert time.time() - began < 30
    for k in (3, 49, 99):
        n = 10_000 * (k + 1)
        alpha, mean, variance = 2 / (n + 1), long[0], 0.0
        for gap in long[1:n]:
            mean, variance = (1 - alpha) * mean + alpha * gap, (1 - alpha) * (variance + alpha * (gap - mean) ** 2)
        assert np.allclose(found[k], (mean, variance), rtol=1e-9, atol=0)


def test_verdicts_with_lift_hints_and_their_withdrawal(spark):
    edges = spark.createDataFrame([("cause", "x", "s", 6.0, 0, 6), ("cause", "y", "s", 5.0, 0, 5), ("x", "y", "s", 1.0, 0, 1), ("far", "x", "s", 50.0, 0, 50)], EDGES)
    candidates = spark.createDataFrame([("s", i) for i in ("cause", "x", "y")] + [("t", "z")], "scope_key string, incident_id string")
    nodes = spark.createDataFrame([("s", i, 8.0) for i in ("cause", "x", "y", "far")], "scope_key string, node string, observations double")
    scopes = spark.createDataFrame([("s", 16.0)], "scope_key string, rounds double")
    verdicts = graph.root_cause(graph.node_lead(graph.among(edges, candidates), nodes, scopes))
    first = verdicts.collect()
    # far is no candidate; lift: 6 * 16 / 64 = 1.5 and 1.25
    assert [(v.leader, v.support) for v in first] == [("cause", 11.0)] and abs(first[0].mean_lift - 1.375) < 1e-12
    titles = spark.createDataFrame([("cause", "db — slow")], "incident_id string, title string")
    said = {r.incident_id: r.hint for r in graph.hints(candidates, verdicts, titles).collect()}
    assert said == dict.fromkeys(("cause", "x", "y"), "db — slow (confidence 100%)") | {"z": None}
    assert {r.hint for r in graph.hints(candidates, verdicts.limit(0), titles).collect()} == {None}


def test_breaker_keeps_its_state_until_a_success(spark):
    hour = 3_600_000
    rows = [("slack", i, i * hour, 503, 1, "pending", 0) for i in range(5)] + [("slack", 5, 5 * hour, 200, 0, "pending", 0), ("slack", 6, 6 * hour, 200, 1, "sent", 2), ("slack", 7, 7 * hour, 503, 1, "sent", 2)]
    box = spark.createDataFrame(rows, "channel string, outbox_id long, created_ms long, http int, k int, status string, priority int")
    folded = {r.outbox_id: (r.state, r.failures, r.step) for r in folds.breaker(box).collect()}
    assert folded == {0: ("CLOSED", 1, 0), 1: ("CLOSED", 2, 0), 2: ("OPEN", 3, 0), 3: ("OPEN", 4, 1), 4: ("OPEN", 5, 2), 5: ("HALF_OPEN", 0, 2), 6: ("CLOSED", 0, 0), 7: ("CLOSED", 1, 0)}
    assert [tuple(r) for r in folds.outages(folds.breaker(box)).collect()] == [("slack", 2 * hour, 6 * hour, 0, 3, 3)]


def test_chain_verifies_and_shows_tampering(spark):
    from tidewatch.sources.alerts import ordinary, read_alerts

    chain = folds.hash_chain(ordinary(read_alerts(spark, SF)))
    assert folds.verify_chain(chain).count() == 0
    assert folds.verify_chain(folds.tampered(chain)).count() > 0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from tidewatch.sources.alerts import ordinary, read_alerts
    from tidewatch.streaming.lifecycle import stream_alerts, stream_incidents

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream_incidents(stream_alerts(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.incident_id: (r.state, r.alert_count, r.reopen_count) for r in spark.table("streamed").collect()}
    batch: dict = defaultdict(tuple)
    for r in folds.lifecycle(ordinary(read_alerts(spark, SF))).collect():
        batch[r.incident_id] = max(batch[r.incident_id], (r.alert_count, r.state, r.reopen_count))
    assert got == {k: (s, n, c) for k, (n, s, c) in batch.items()}


def test_every_query_has_the_columns_of_its_oracle(spark):
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, text in catalog.ORACLE_SQL.items():
        assert set(db.sql(f"DESCRIBE {text}").df()["column_name"]) == set(catalog.QUERIES[name](spark, SF).columns) if name not in ITERATIVE else True, name


#: These run jobs when they are built.
ITERATIVE = {"storm_components", "storm_anchor", "group_rollup", "group_root", "group_snapshot", "tree_walk", "ledger_seals", "ledger_check", "patch_verdicts", "patch_proposals", "selection_deltas"}


def test_stream_timers_make_incidents_quiescent_and_resolve_them(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewatch.streaming.lifecycle import stream_transitions

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = 1_700_000_000_000
    steps = [[("a", 1, base, base, "firing")], [("b", 2, base + 20_000, base + 20_000, "firing")], [("b", 3, base + 60_000, base + 60_000, "resolved")], [("c", 4, base + 4_000_000, base + 4_000_000, "firing")]]
    schema = ALERT + ", bypass string"
    for k, rows in enumerate(steps):
        alerts_of(spark, rows).withColumn("bypass", F.lit(None).cast("string")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = stream_transitions(stream).writeStream.outputMode("update").format("memory").queryName("moved").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r.incident_id, r.cause, r.state, r.at_ms - base) for r in spark.table("moved").collect()}
    assert ("a", "quiet_deadline", "QUIESCENT", 5_000) in got and ("a", "inferred_silence", "RESOLVED", 900_000) in got
    assert ("b", "alert", "RESOLVED", 60_000) in got and not [x for x in got if x[0] == "b" and x[1] == "inferred_silence"]
    assert ("c", "alert", "ACKNOWLEDGED", 4_000_000) in got


def test_selections_follow_events_that_take_effect(spark):
    import random

    r, rows, nr = random.Random(4), [], 0
    for inst in range(12):
        for _ in range(r.randint(0, 14)):
            nr += 1
            action = r.choice(["created", "removed", "created", "removed", "created", "suspend", "unsuspend", "deleted"] if inst % 3 else ["created", "removed"])
            names = [r.randrange(6) for _ in range(3)] if action in ("created", "removed") else []
            rows.append((inst, nr, r.randint(1, 9) + nr // 3, r.choice([10, 70]), action, names[:2] or None, names[2:] or None, "odd"))
    known = [(inst, repository, inst % 2 == 0) for inst in range(13) for repository in (0, 1)]
    want, due, states = {(i, p): s for i, p, s in known}, set(), {}
    for inst, _, at, prio, action, added, removed, _ in rows:
        state = states.get(inst)
        blocked = state and (state[2] == "deleted" or (at, prio) <= state[:2] or (state[2] == "suspend" and action not in ("unsuspend", "deleted")))
        if blocked:
            due |= {inst} if action in ("created", "removed") else set()
            continue
        states[inst] = (at, prio, action)
        want |= {(inst, p): True for p in added or []}
        want |= {(inst, p): False for p in removed or []}
    schema = "inst long, nr long, at_us long, prio int, action string, added array<int>, removed array<int>, selected string"
    got = folds.selections(spark.createDataFrame(known, "inst long, repository int, selected boolean"), spark.createDataFrame(rows, schema)).collect()
    assert {(x.inst, x.repository): x.selected for x in got} == want and len(got) == len(want)
    assert {x.inst for x in got if x.sync_due} == due and due
