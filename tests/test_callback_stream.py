"""Streamed callbacks against the batch form over the whole history, and delivery ids that expire."""

import random
import time

import pytest

from tidewatch.operators import callbacks as B
from tidewatch.streaming.callbacks import stream_reconciled

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAME = "spark.sql.streaming.stateStore.providerClass"
ALERTS = "inc string, event_id long, status string, ingested_ms long, bypass string"
TOLD = "callback_id long, inbound_id string, incident_id string, provider string, kind string, actor string, source string, detail string, at_ms long"


@pytest.fixture
def rocks(spark):
    # with states that expire, batches without data would follow for ever
    wanted = {NAME: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def streamed(spark, at, steps, pause=0.0, **how):
    """Rows of the stream, of one micro-batch for each of steps (alerts, callbacks)."""
    found = []
    for k, (alerts, told) in enumerate(steps):
        spark.createDataFrame(alerts, ALERTS).coalesce(1).write.mode("append").parquet(str(at / "alerts"))
        spark.createDataFrame(told, TOLD).coalesce(1).write.mode("append").parquet(str(at / "told"))
        read = lambda name, schema: spark.readStream.schema(schema).parquet(str(at / name))
        out = stream_reconciled(read("alerts", ALERTS), read("told", TOLD), **how)
        out.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(at / "at")).trigger(availableNow=True).start().awaitTermination()
        time.sleep(pause if k + 1 < len(steps) else 0)
    return found


def test_stream_equals_batch(spark, rocks, tmp_path):
    r = random.Random(5)
    alerts = [(r.choice("abc"), k, r.choice(["firing", "firing", "resolved"]), r.randrange(300), None) for k in range(60)]
    told = [(k, f"d{r.randrange(120)}", r.choice("abcx"), r.choice(["slack", "pagerduty"]), r.choice(["resolve", "resolve", "acknowledge", "note", None]), r.choice([None, "u"]), r.choice(["operator", "inferred_silence"]), r.choice([None, "d1", "d2"]), r.randrange(320)) for k in range(140)]
    steps = [([a for a in alerts if low <= a[3] < high], [t for t in told if low <= t[8] < high]) for low, high in ((0, 110), (110, 220), (220, 400))]
    got = streamed(spark, tmp_path, steps)
    verdicts = B.reconciled(spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(told, TOLD))
    want = {x.callback_id: (x.incident_id, x.verdict, x.reason) for x in verdicts.collect()}
    assert len(got) == len(told) and {x.callback_id: (x.incident_id, x.verdict, x.reason) for x in got} == want
    assert {v for _, v, _ in want.values()} == {"applied", "duplicate", "ignored"} and "unknown incident" in {w[2] for w in want.values()}
    # an incident's last row has the provenance of its whole history
    at = {t[0]: t[8] for t in told}
    last = {}
    for x in sorted(got, key=lambda x: (at[x.callback_id], x.callback_id)):
        last[x.incident_id] = x
    first = B.provenance(verdicts).collect()
    assert len(first) >= 2
    for p in first:
        assert tuple(last[p.incident_id][c] for c in p.asDict()) == tuple(p), p


def test_delivery_ids_expire(spark, rocks, tmp_path):
    call = lambda n, at: (n, "same", "a", "slack", "resolve", None, "operator", None, at)
    steps = [([("a", 1, "firing", 0, None)], [call(1, 5), call(2, 6)]), ([("a", 2, "firing", 10, None)], [call(3, 15)])]
    kept = streamed(spark, tmp_path / "kept", steps)
    assert {x.callback_id: x.verdict for x in kept} == {1: "applied", 2: "duplicate", 3: "duplicate"}
    gone = streamed(spark, tmp_path / "gone", steps, pause=3.0, ttl_ms=1000)
    assert {x.callback_id: x.verdict for x in gone} == {1: "applied", 2: "duplicate", 3: "applied"}
    # reopened in between, and resolved again: the first resolution stays on record
    assert {x.resolved_ms for x in gone} == {5}
