"""Callbacks against a plain fold over the merged history, failover against the breakers' states at that moment, and counts by time."""

import random

from pyspark.sql import functions as F

from tidewatch.functions.columns import LIFECYCLE
from tidewatch.operators import callbacks, folds
from tidewatch.operators.counts import counted, latest_before, placed

TOLD = "callback_id long, inbound_id string, incident_id string, provider string, kind string, actor string, source string, detail string, at_ms long"
KINDS = {"acknowledge": "ACKNOWLEDGE", "resolve": "RESOLVE"}


def folded(alerts, told):
    """Every alert and callback in turn, on one dictionary of incidents and one set of delivery ids."""
    states, seen, found, first = {}, set(), {}, {}
    merged = [(at, 0, e, (inc, status)) for inc, e, status, at in alerts] + [(r[8], 1, r[0], r) for r in told]
    for at, turn, _, row in sorted(merged, key=lambda x: x[:3]):
        if turn == 0:
            states[row[0]] = "RESOLVED" if row[1] == "resolved" else "ACKNOWLEDGED"
            continue
        key, inbound, inc, provider, kind, actor, source, detail, _ = row
        state = states.get(inc)
        if inbound in seen:
            verdict = ("duplicate", "replayed")
        elif kind not in KINDS:
            verdict = ("ignored", f"unknown kind: {kind or ''}")
        elif state is None:
            verdict = ("ignored", "unknown incident")
        elif (state, KINDS[kind]) not in LIFECYCLE:
            verdict = ("ignored", f"no transition from {state}")
        else:
            states[inc] = LIFECYCLE[state, KINDS[kind]]
            verdict = ("applied", f"{state} -> {states[inc]}")
            kept = first.setdefault(inc, [None] * 4)
            first[inc] = [k if k is not None else v for k, v in zip(kept, (at, provider, source, detail))]
        seen.add(inbound)
        found[key] = verdict
    return found, states, {k: tuple(v) for k, v in first.items()}


def test_callbacks_equal_a_plain_fold(spark):
    r = random.Random(9)
    alerts = [(r.choice("abc"), k, r.choice(["firing", "firing", "resolved"]), r.randrange(300)) for k in range(120)]
    told = [(k, f"d{r.randrange(200)}", r.choice("abcx"), r.choice(["slack", "pagerduty"]), r.choice(["resolve", "resolve", "acknowledge", "note", None]), None, r.choice(["operator", "inferred_silence"]), r.choice([None, "d1", "d2"]), r.randrange(320)) for k in range(250)]
    rows = spark.createDataFrame(alerts, "inc string, event_id long, status string, ingested_ms long")
    verdicts = callbacks.reconciled(rows, spark.createDataFrame(told, TOLD))
    found, states, first = folded(alerts, told)
    got = verdicts.collect()
    assert {v.callback_id: (v.verdict, v.reason) for v in got} == found
    assert {v[0] for v in found.values()} == {"applied", "duplicate", "ignored"} and len({v[1] for v in found.values()}) == 7
    assert {p.incident_id: (p.resolved_ms, p.resolved_via, p.resolution_source, p.resolution_detail) for p in callbacks.provenance(verdicts).collect()} == first
    status = {inc: "RESOLVED" if max((at, e, s) for i, e, s, at in alerts if i == inc)[2] == "resolved" else "ACKNOWLEDGED" for inc in "abc"}
    table = spark.createDataFrame(list(status.items()), "incident_id string, status string")
    assert {i.incident_id: i.status for i in callbacks.after_callbacks(table, rows, verdicts).collect()} == states
    for i in callbacks.intents(verdicts).collect():
        assert i.channel in ("slack", "pagerduty") and i.action == "resolve" and i.idempotency_key.endswith(i.channel)


def test_failover_takes_the_first_channel_that_is_up_then(spark):
    down = lambda c, at: [(c, at + k, 10 * at + k, 503, 1, "sent", None, None, "i", "create") for k in range(3)]
    ok = lambda c, at: [(c, at, 10 * at, 200, 1, "sent", None, None, "i", "create")]
    urgent = lambda c, at, action="update": [(c, at, 10 * at + 5, 200, 1, "pending", 0, None, "i", action)]
    rows = down("pagerduty", 100) + urgent("email", 50) + down("slack", 200) + [("slack", 150, 1, 404, 1, "pending", 1, None, "late", "update"), ("slack", 151, 2, 404, 1, "pending", 2, None, "calm", "update"), ("slack", 152, 3, 404, 1, "pending", None, None, "calm", "update"), ("slack", 153, 4, 404, 1, "pending", 1, 7, "moved", "update")]
    rows += ok("pagerduty", 300) + ok("slack", 400) + [("slack", 450, 5, 404, 1, "pending", 0, None, "second", "resolve")] + down("slack", 500) + [("slack", 600, 6, 404, 1, "pending", 0, None, "after", "update")]
    schema = "channel string, created_ms long, outbox_id long, http int, k int, status string, priority int, failover_of long, incident_id string, action string"
    box = spark.createDataFrame(rows, schema)
    got = {r.incident_id: (r.channel, r.action, r.failover_from, r.moved_ms) for r in folds.failovers(box, folds.breaker(box)).collect()}
    # pagerduty is down when slack fails first, and up again when it fails next; email has no fallback, and what comes later waits
    assert got == {"late": ("email", "create", "slack", 202), "second": ("pagerduty", "resolve", "slack", 502)}


def test_counts_and_as_of_joins_on_uneven_times(spark):
    r = random.Random(3)
    times = [r.choice([5, 5, 5, 999, 1000, 3_600_000, 7_200_001]) + r.randrange(3) for _ in range(300)]
    rows = spark.createDataFrame([(r.choice("ab"), t, k, r.random() < 0.5) for k, t in enumerate(times)], "c string, ms long, id long, good boolean")
    want, n = {}, {}
    for row in sorted(rows.collect(), key=lambda x: (x.ms, x.id)):
        n[row.c] = n.get(row.c, 0) + row.good
        want[row.id] = n[row.c]
    assert {x.id: x.n for x in counted(rows, ["c"], "ms", ["ms", "id"], n=F.col("good")).collect()} == want
    states, moments = rows.filter("good").drop("good"), rows.filter("NOT good").drop("good")
    known = [(s.c, s.ms, s.id) for s in states.collect()]
    for m in latest_before(moments, states, ["c"], "ms", "id").collect():
        old = [(s[1], s[2]) for s in known if s[0] == m.c and s[1] <= m.ms]
        assert (m.now and (m.now.ms, m.now.id)) == (max(old) if old else None)
    for m in latest_before(moments, states, ["c"], "ms", "id", after=True).collect():
        new = [(s[1], s[2]) for s in known if s[0] == m.c and s[1] > m.ms]
        assert (m.now and (m.now.ms, m.now.id)) == (min(new) if new else None)


def test_places_in_an_order_over_many_ranges(spark):
    r = random.Random(3)
    rows = [(k, r.choice([None, 1, 1, 2, 7]), r.choice("ab")) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, n int, place string").repartition(5)
    got = placed(df, [F.desc("n"), F.asc("id")], "at")
    assert got.columns == ["id", "n", "place", "at"]
    want = sorted(rows, key=lambda x: (-(x[1] if x[1] is not None else -1), x[0]))
    assert {x.id: x.at for x in got.collect()} == {row[0]: k for k, row in enumerate(want, 1)}
    assert placed(df.limit(0), [F.asc("id")], "at").count() == 0
