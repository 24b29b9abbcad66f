"""The breaker by counts against its step replayed, and digests of outages against their SQL."""

import random
import time

import duckdb

from tidewatch import catalog
from tidewatch.operators import folds

SCHEMA = "channel string, outbox_id long, created_ms long, http int, k int, status string, priority int"
SF = "/root/testdata/sf0.001"
START = {"state": "CLOSED", "failures": 0, "step": 0, "opened": None, "probe": None}


def test_counts_give_what_the_step_gives(spark):
    r, rows = random.Random(7), []
    for k in range(3000):
        channel = r.choice(["slack", "email", "never"])
        http = r.choice([429, 503, 503, 400] if channel == "never" else [200, 429, 503, 503, 503, 401, 400])
        rows.append((channel, k, r.choice([0, 1, 999, 1000, 3_600_000, 7_200_001]) * r.randrange(4) + r.randrange(3), http, r.choice([0, 1, 1, 2, 3]), "pending", 0))
    want, state = {}, {}
    kinds = {x.outbox_id: x.kind for x in folds.results(spark.createDataFrame(rows, SCHEMA)).collect()}
    for channel, k, at, *_ in sorted(rows, key=lambda x: (x[2], x[1])):
        state[channel] = now = folds.breaker_step(state.get(channel, START), kinds[k], at)
        want[k] = (now["state"], now["failures"], now["step"], now["probe"])
    got = {x.outbox_id: (x.state, x.failures, x.step, x.probe_ms) for x in folds.breaker(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert {x.outbox_id: (x.state, x.failures) for x in folds.states(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: x[:2] for k, x in want.items()}


def test_a_step_costs_the_same_however_long_the_outage():
    state = START | {"state": "OPEN", "opened": 0, "step": 20_000_000}
    began = time.perf_counter()
    for at in range(200):
        state = folds.breaker_step(state, "probe_fail", at)
    assert time.perf_counter() - began < 1
    assert state["step"] == 20_000_200 and state["probe"] == 199 + 1000 * folds.PROBE_MAX


def test_no_channel_passes_through_one_task(spark):
    """A channel that never succeeds is one stretch; it is not dealt by its key alone, nor folded in Python."""
    rows = spark.range(2000).selectExpr("'email' AS channel", "id AS outbox_id", "id * 700 AS created_ms", "503 AS http", "1 AS k", "'pending' AS status", "0 AS priority")
    plan = folds.breaker(rows)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan
    assert folds.breaker(rows).filter("state = 'OPEN'").agg({"step": "max"}).first()[0] == 1997


def test_digests_count_what_fell_into_an_outage(spark):
    got = sorted(tuple(r) for r in catalog.QUERIES["recovery_digest"](spark, SF).select("incident_id", "duration_s", "touched", "critical", "resolved", "queued", "collapsed", "failed_over").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = db.execute(f"SELECT incident_id, duration_s, touched, critical, resolved, queued, collapsed, failed_over FROM ({catalog.ORACLE_SQL['recovery_digest']})").fetchall()
    assert got == sorted(want) and got
