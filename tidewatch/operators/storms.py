"""Storms as arriving alerts build them up: groups that form around an anchor, grow, merge and end.

An alert's incident joins those it has strong edges with, if they are active at that moment; of groups that meet, the
oldest survives with its anchor, whatever arrives later. No member ever leaves, so in batch the groups are the components
of all links, and a component's oldest group is the one that its first link formed: no scope has to be replayed by one task.
`Replay` is the same as a fold over single alerts, for streams.

What was joined stays joined, so of all alerts that join two incidents only the first counts. Edges are rows only as sums
over parts of a scope's history; rounds are held in the fold of a part and never written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _RATE, HALF_LIFE, NEIGHBOURS, PARTS, RUN, STORM_WEIGHT, WINDOW_MS, _runs, components, directed, group_roots, partial, rounds
from .store import written

#: What rounds to STORM_WEIGHT at nine digits.
_STRONG = STORM_WEIGHT - 5e-10


def _halved(weight: float, elapsed: int) -> float:
    return weight * math.exp(-math.log(2.0) * max(0, elapsed) / HALF_LIFE)


def _folded(rows: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable) -> DataFrame:
    """Sorted partitions of rows stream through step(carried, row), which gives an output row and what it carries to the key's next row (None at first)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, carried, names = None, None, [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[: len(keys)] != key:
                    key, carried = row[: len(keys)], None
                found, carried = step(carried, row)
                out.append(found)
            yield pd.DataFrame(out, columns=names)

    first = [*keys, *order]
    return rows.select(*first, *(c for c in rows.columns if c not in first)).repartition(*keys).sortWithinPartitions(*first).mapInPandas(run, schema)


def _carried(parts: DataFrame) -> DataFrame:
    """scope_key, src, dst, part, before, seen, after, last_cf, until: an edge's weight and time as it comes into each part that
    observes it (0 into its first), what it is after that part, and the next such part."""
    edge = ["scope_key", "src", "dst"]

    def over(carried: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        *key, first_cf, last_cf, span, own = row
        before, seen = carried or (0.0, first_cf)
        after = own + _halved(_halved(before, first_cf - seen), span)
        return (*key, before, seen, after, last_cf), (after, last_cf)

    rows = parts.filter("dst IS NOT NULL").select(*edge, "part", "first_cf", "last_cf", "span", F.col("w").alias("own"))
    found = _folded(rows, edge, ["part"], "scope_key string, src string, dst string, part long, before double, seen long, after double, last_cf long", over)
    return found.withColumn("until", F.lead("part").over(Window.partitionBy(*edge).orderBy("part")))


def _openings(ordinary: DataFrame, parts: DataFrame, runs: DataFrame) -> DataFrame:
    """What a run has to know before its first alert: the weights of edges that it observes or whose strength an alert of it
    may ask for (inc, other: the edge; weight, cf: when last observed), and the states of their ends (other is empty)."""
    carried = written(_carried(parts), "carried")
    last = runs.filter("arrives").groupBy("scope_key", "run", "inc").agg(F.max_by("status", F.struct("ct", "event_id")).alias("status"))
    last = written(last, "states")
    edge = ["scope_key", "src", "dst"]
    observed = carried.filter("before > 0").select(*edge, F.col("part").alias("run"), F.col("before").alias("weight"), F.col("seen").alias("cf"))
    standing = carried.filter(F.col("after") >= _STRONG).select(*edge, "part", "until", F.col("after").alias("weight"), F.col("last_cf").alias("cf"))
    asked = [standing.join(last.select("scope_key", "run", F.col("inc").alias(end)), ["scope_key", end]).filter("run > part AND (until IS NULL OR run < until)").select(*edge, "run", "weight", "cf") for end in ("src", "dst")]
    edges = written(observed.unionByName(asked[0].unionByName(asked[1]).distinct()), "openings")
    ends = edges.filter(F.col("weight") >= _STRONG).select("scope_key", "run", F.explode(F.array("src", "dst")).alias("inc")).distinct()
    # dealt by a hash of the key: Spark 4.1 takes a union of two sides dealt by the key itself for dealt by it, and adaptive plans break that
    moments = ends.withColumn("asks", F.lit(True)).unionByName(last.withColumn("asks", F.lit(False)), allowMissingColumns=True).repartition(F.xxhash64("scope_key", "inc"))
    before = F.last("status", ignorenulls=True).over(Window.partitionBy("scope_key", "inc").orderBy("run", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1))
    known = moments.withColumn("status", F.when(F.col("asks"), before)).filter("asks").select("scope_key", "run", "inc", "status", F.lit("").alias("other"), F.lit(0).cast("long").alias("cf"))
    return edges.select("scope_key", "run", F.col("src").alias("inc"), F.col("dst").alias("other"), "weight", "cf").unionByName(known, allowMissingColumns=True)


def _linked(rows: DataFrame) -> DataFrame:
    """scope_key, ct, event_id, node, other: in each run the first alert that joins node with other, of runs that begin with
    their openings (turn 0), then with the incidents present (turn 1).

    Sorted partitions stream by; a run's edges are held at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for frame in frames:
            out: list[tuple] = []
            for scope, number, turn, at, event, inc, fired, status, other, weight in frame.itertuples(index=False, name=None):
                if (scope, number) != key:
                    key = (scope, number)
                    present: dict[str, tuple[int, int]] = {}
                    edges: dict[tuple[str, str], list] = {}
                    resolved: dict[str, bool] = {}
                    strong: dict[str, dict[tuple[str, str], str]] = {}  # of a node its strong edges, with the other end
                    joined: dict[str, set[str]] = {}
                    open_: dict[str, set[str]] = {}  # of a node those it has a strong edge with, not yet joined

                    def turned(edge: tuple[str, str], on: bool) -> None:
                        for node, far in (edge, edge[::-1]):
                            mine = strong.setdefault(node, {})
                            if on:
                                mine[edge] = far
                                if far not in joined.get(node, ()):
                                    open_.setdefault(node, set()).add(far)
                            else:
                                del mine[edge]
                                if far not in mine.values():
                                    open_.get(node, set()).discard(far)

                if turn == 0:
                    if not other:
                        resolved[inc] = status == "resolved"
                    else:
                        on = weight >= _STRONG
                        edges[inc, other] = [weight, fired, on]
                        if on:
                            turned((inc, other), True)
                    continue
                present.pop(inc, None)
                if turn == 1:
                    present[inc] = (at, fired)
                    continue
                resolved[inc] = status == "resolved"
                if status != "resolved":
                    present[inc] = (at, fired)
                    for src, dst, _ in rounds(present, inc, at, fired):
                        row = edges.get((src, dst))
                        if row is None:
                            edges[src, dst] = [1.0, fired, False]
                            continue
                        weight, step = row[0], fired - row[1]
                        row[0] = weight = (weight * math.exp(step * _RATE) if step > 0 else weight) + 1.0
                        row[1] = fired
                        if (weight >= _STRONG) != row[2]:
                            row[2] = not row[2]
                            turned((src, dst), row[2])
                wanted = open_.get(inc)
                if not wanted:
                    continue
                mine = strong[inc]
                if len(mine) <= NEIGHBOURS:
                    near = [far for far in wanted if not resolved.get(far, False)]
                else:
                    best: dict[str, float] = {}
                    for edge, far in mine.items():
                        if not resolved.get(far, False):
                            best[far] = max(round(edges[edge][0], 9), best.get(far, 0.0))
                    near = [far for far in sorted(best, key=lambda far: (-round(best[far], 6), far))[:NEIGHBOURS] if far in wanted]
                for far in near:
                    out.append((scope, at, event, inc, far))
                    joined.setdefault(inc, set()).add(far)
                    wanted.discard(far)
            yield pd.DataFrame(out, columns=["scope_key", "ct", "event_id", "node", "other"])

    first = ["scope_key", "run", "turn", "ct", "event_id"]
    ordered = rows.select(*first, "inc", "cf", "status", F.coalesce("other", F.lit("")).alias("other"), F.coalesce("weight", F.lit(0.0)).alias("weight")).repartition(F.xxhash64("scope_key", "run")).sortWithinPartitions(*first)
    return ordered.mapInPandas(run, "scope_key string, ct long, event_id long, node string, other string")


def links_of(ordinary: DataFrame, parts: DataFrame, size: int = RUN * PARTS) -> DataFrame:
    """scope_key, ct, event_id, node, other: the first alert that joined its incident, node, with other, of the parts_of() edges.

    A scope's alerts are taken in its parts, each a group of its own that begins with the weights and states of that moment.
    What was joined stays joined, so later alerts that join the same two change nothing.
    """
    runs = _runs(ordinary, size, WINDOW_MS, NEIGHBOURS)
    parts = parts.withColumn("part", F.floor(F.col("part") / 2))
    opened = _openings(ordinary, parts, runs).withColumns({"turn": F.lit(0), "ct": F.lit(0).cast("long"), "event_id": F.lit(0).cast("long")})
    rows = runs.withColumn("turn", F.when(F.col("arrives"), 2).otherwise(1)).drop("arrives").unionByName(opened, allowMissingColumns=True)
    found = _linked(rows).groupBy("scope_key", "node", "other").agg(F.min(F.struct("ct", "event_id")).alias("x"))
    return found.select("scope_key", "x.ct", "x.event_id", "node", "other")


def links(ordinary: DataFrame, observed: DataFrame) -> DataFrame:
    """links_of() from observations as rows."""
    edge = ["scope_key", "src", "dst"]
    return links_of(ordinary, partial(directed(observed), edge).withColumn("part", F.col("part") * 2))


def storm_members(linked: DataFrame, incidents: DataFrame) -> DataFrame:
    """incident_id, group_id (the anchor, which never changes), formed_event, formed_ms."""
    found = written(components(linked.select(F.col("node").alias("src"), F.col("other").alias("dst"))), "groups")
    births = linked.join(found, "node").groupBy("component").agg(F.min(F.struct("ct", "event_id")).alias("born"))
    # the alert that formed a group had at most so many neighbours: its anchor is the first of them to have fired
    first = births.select("component", "born.ct", "born.event_id").join(linked.drop("ct"), "event_id")
    party = first.select("component", "ct", "event_id", F.explode(F.array("node", "other")).alias("incident_id")).join(incidents.select("incident_id", "first_alert_ms"), "incident_id")
    anchors = party.groupBy("component").agg(F.min(F.struct("first_alert_ms", "incident_id"))["incident_id"].alias("group_id"), F.first("event_id").alias("formed_event"), F.first("ct").alias("formed_ms"))
    return found.join(anchors, "component").select(F.col("node").alias("incident_id"), "group_id", "formed_event", "formed_ms")


def storm_facts(members: DataFrame, incidents: DataFrame, edges: DataFrame, rank: Column) -> DataFrame:
    """What a group's members make of it: scope_key, group_id, formed_event, formed_ms, members, severity (by rank), status, root, title."""
    rows = members.join(incidents.select("incident_id", "scope_key", "severity", "status", "first_alert_ms"), "incident_id")
    place = F.struct("first_alert_ms", "incident_id")
    grouped = rows.groupBy("group_id").agg(
        F.first("scope_key").alias("scope_key"), F.first("formed_event").alias("formed_event"), F.first("formed_ms").alias("formed_ms"), F.count(F.lit(1)).alias("members"),
        F.min_by("severity", rank).alias("severity"), F.when(F.bool_or(F.col("status") != "RESOLVED"), "OPEN").otherwise("RESOLVED").alias("status"), F.min(place)["incident_id"].alias("first"),
    )
    roots = group_roots(edges, members.select(F.col("incident_id").alias("node"), F.col("group_id").alias("component"))).select(F.col("component").alias("group_id"), "root")
    rooted = grouped.join(roots, "group_id", "left").withColumn("root", F.coalesce("root", "first")).drop("first")
    titled = rooted.join(incidents.select(F.col("incident_id").alias("root"), "title"), "root")
    return titled.withColumn("title", F.concat("title", F.lit(" (+"), (F.col("members") - 1).cast("string"), F.lit(" correlated)")))


class Replay:
    """One scope's incidents, edges and groups, alert by alert. `changed` names what a step wrote, for a state store to keep."""

    def __init__(self) -> None:
        self.incidents: dict[str, tuple] = {}  # status, arrival, event, fired, first fired, severity, group
        self.edges: dict[tuple[str, str], tuple[float, int]] = {}
        self.groups: dict[str, tuple] = {}  # formed ms, formed event
        self.near: dict[str, set[tuple[str, str]]] = {}
        self.members: dict[str, set[str]] = {}
        self.changed: set[tuple[str, object]] = set()

    def restore(self, incidents: dict, edges: dict, groups: dict) -> Replay:
        self.incidents, self.edges, self.groups = incidents, edges, groups
        for edge in edges:
            for end in edge:
                self.near.setdefault(end, set()).add(edge)
        for name, row in incidents.items():
            if row[6]:
                self.members.setdefault(row[6], set()).add(name)
        return self

    def _observe(self, inc: str, at: int, fired: int) -> None:
        active = [(row[1], row[2], name) for name, row in self.incidents.items() if row[0] != "resolved" and row[1] >= at - WINDOW_MS]
        recent = sorted(active, reverse=True)[:NEIGHBOURS]
        for other in (name for _, _, name in recent if name != inc and self.incidents[inc][0] != "resolved"):
            edge = (other, inc) if self.incidents[other][3] <= fired else (inc, other)
            weight, seen = self.edges.get(edge, (0.0, fired))
            self.edges[edge] = (weight * math.exp(-math.log(2.0) * max(0, fired - seen) / HALF_LIFE) + 1.0, fired)
            self.changed.add(("edge", edge))
            for end in edge:
                self.near.setdefault(end, set()).add(edge)

    def _neighbours(self, inc: str) -> list[str]:
        best: dict[str, float] = {}
        for edge in self.near.get(inc, ()):
            weight, other = round(self.edges[edge][0], 9), edge[edge[0] == inc]
            if weight >= STORM_WEIGHT and self.incidents[other][0] != "resolved":
                best[other] = max(weight, best.get(other, weight))
        return sorted(best, key=lambda name: (-round(best[name], 6), name))[:NEIGHBOURS]

    def step(self, inc: str, event: int, status: str, severity: str, at: int, fired: int) -> str | None:
        """One alert; the group that its incident belongs to afterwards, if any."""
        old = self.incidents.get(inc)
        self.incidents[inc] = (status, at, event, fired, old[4] if old else fired, severity, old[6] if old else None)
        self.changed.add(("incident", inc))
        self._observe(inc, at, fired)
        near = self._neighbours(inc)
        if not near:
            return self.incidents[inc][6]
        party = [inc, *near]
        met = {self.incidents[name][6] for name in party} - {None}
        if met:
            group = min(met, key=lambda g: self.groups[g])
        else:
            group = min(party, key=lambda name: (self.incidents[name][4], name))
            self.groups[group] = (at, event)
            self.changed.add(("group", group))
        for gone in met - {group}:
            party += self.members.pop(gone)
            del self.groups[gone]
            self.changed.add(("group", gone))
        for name in party:
            if self.incidents[name][6] != group:
                self.incidents[name] = (*self.incidents[name][:6], group)
                self.changed.add(("incident", name))
            self.members.setdefault(group, set()).add(name)
        return group

    def facts(self, group: str) -> tuple:
        """group, anchor's birth (ms, event), members, active members, root."""
        names = self.members[group]
        outbound: dict[str, float] = {}
        for name in names:
            for edge in self.near.get(name, ()):
                if edge[0] == name and edge[1] in names:
                    outbound[name] = outbound.get(name, 0.0) + self.edges[edge][0]
        first = min(names, key=lambda n: (self.incidents[n][4], n))
        root = min(outbound, key=lambda n: (-round(outbound[n], 6), n)) if outbound else first
        return group, *self.groups[group], len(names), sum(self.incidents[n][0] != "resolved" for n in names), root
