"""Edges, nodes and storms from sums over parts of a history: many small parts against observations as rows and a replay."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch import catalog
from tidewatch.operators import graph, storms
from tidewatch.operators.incidents import incidents

SF = "/root/testdata/sf0.001"
ALERTS = "scope_key string, inc string, event_id long, status string, severity string, message string, service string, alertname string, ingested_ms long, fired_ms long"


def history(spark, names, n, seed):
    r, at, rows = random.Random(seed), 0, []
    for k in range(n):
        at += r.choice([0, 1, 5, 60, 400, 400])
        scope = r.choice("st")
        rows.append((scope, scope + r.choice(names), k, r.choice(["firing", "firing", "firing", "resolved"]), "low", "m", "x", "y", at * 1000, (at - r.choice([0, 0, 3, 500])) * 1000))
    return spark.createDataFrame(rows, ALERTS)


@pytest.mark.parametrize(("names", "n", "size"), [("abcdefg", 500, 16), ([f"{k:02}" for k in range(40)], 700, 64)])
def test_small_parts_give_the_whole(spark, names, n, size):
    df = history(spark, names, n, n)
    seen = graph.observations(df).localCheckpoint()
    parts = graph.parts_of(df, nodes=True, size=size).localCheckpoint()
    got = {(r.scope_key, r.src, r.dst): (r.weight, r.last_seen_ms, r.n) for r in graph.edges_of(parts).collect()}
    want = {(r.scope_key, r.src, r.dst): (r.weight, r.last_seen_ms, r.n) for r in graph.edges(seen).collect()}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
    got = {(r.scope_key, r.node): (r.observations, r.last_observed_ms) for r in graph.nodes_of(parts).collect()}
    want = {(r.scope_key, r.node): (r.observations, r.last_observed_ms) for r in graph.node_stats(seen).collect()}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
    scopes = defaultdict(storms.Replay)
    for r in sorted(df.collect(), key=lambda r: (r.ingested_ms, r.event_id)):
        scopes[r.scope_key].step(r.inc, r.event_id, r.status, r.severity, r.ingested_ms, r.fired_ms)
    want = {name: (group, *replay.groups[group]) for replay in scopes.values() for group, mine in replay.members.items() for name in mine}
    linked = storms.links_of(df, parts, size)
    assert want and {r.incident_id: (r.group_id, r.formed_ms, r.formed_event) for r in storms.storm_members(linked, incidents(df)).collect()} == want


def test_what_was_is_merged_from_the_same_parts(spark):
    df = history(spark, "abcdef", 400, 9)
    cut = df.agg(F.percentile_approx("ingested_ms", 0.6)).first()[0]
    parts = graph.parts_of(df, cut_ms=cut, size=32).localCheckpoint()
    rows = lambda e: {(r.scope_key, r.src, r.dst): (r.weight, r.last_seen_ms, r.n) for r in e.collect()}
    for got, of in ((parts.filter("part % 2 = 0"), df.filter(F.col("ingested_ms") <= cut)), (parts, df)):
        got, want = rows(graph.edges_of(got)), rows(graph.edges(graph.observations(of)))
        assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)


@pytest.mark.parametrize("name", ["storm_links", "storm_members", "storm_groups", "storm_status_after_callbacks", "hint_changes"])
def test_no_rows_of_observations(spark, monkeypatch, name):
    """An alert makes 25 of them; they filled the disk."""

    def refuse(*_):
        raise AssertionError("observations as rows")

    monkeypatch.setattr(graph, "observations", refuse)
    assert catalog.QUERIES[name](spark, SF).collect() is not None
