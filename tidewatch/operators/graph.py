"""The co-occurrence graph: who was active when an alert arrived, decayed weights, root causes, storms.

Who was there is decided on our clock (ingest time, in order of arrival); how old evidence is, on the sources' clocks. An
alert that arrives late ages nothing: elapsed time is never below 0.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .counts import counted
from .store import written

WINDOW_MS, NEIGHBOURS, HALF_LIFE = 900_000, 25, 3_600_000.0
#: Alerts of a scope that are folded together, and how many such runs make a part of its history.
RUN, PARTS, BUCKET_MS = 512, 64, 60_000
_RATE = -math.log(2.0) / HALF_LIFE
MIN_SUPPORT, FULL_SUPPORT, MIN_CONFIDENCE, MIN_DOMINANCE = 1.5, 6.0, 0.35, 0.25
STORM_WEIGHT, ROUNDS = 1.5, 50


def numbered(ordinary: DataFrame) -> DataFrame:
    """scope_key, inc, ct, event_id, cf, status, pos of each alert: its place in its scope, in order of arrival."""
    rows = ordinary.select("scope_key", "inc", F.col("ingested_ms").alias("ct"), "event_id", F.col("fired_ms").alias("cf"), "status")
    return counted(rows, ["scope_key"], "ct", ["ct", "event_id"], pos=F.lit(True))


def _runs(ordinary: DataFrame, size: int, window_ms: int, neighbours: int) -> DataFrame:
    """scope_key, run, arrives, ct, event_id, inc, cf, status: a scope's alerts in runs of so many, sorted partitions of whole runs.

    Before a run's alerts come the incidents active at its first one (arrives is false), of which the latest neighbours + size
    suffice: each of its alerts takes one away at most.
    """
    alerts = written(numbered(ordinary).withColumn("run", F.floor((F.col("pos") - 1) / size)), "numbered")
    arrivals = Window.partitionBy("inc").orderBy("ct", "event_id")
    stretches = alerts.withColumns({"until": F.lead("ct").over(arrivals), "until_run": F.lead("run").over(arrivals)}).filter("status <> 'resolved'")
    columns = ["scope_key", "inc", "ct", "event_id", "cf"]
    renewed = F.col("until") <= F.col("ct") + window_ms
    # until the incident's next alert the runs are known; else they are those that begin in the minutes of the window
    held = stretches.filter(renewed & (F.col("until_run") > F.col("run"))).select(*columns, F.explode(F.sequence(F.col("run") + 1, F.col("until_run"))).alias("run"))
    begun = alerts.filter((F.col("pos") - 1) % size == 0).groupBy("scope_key", F.floor(F.col("ct") / BUCKET_MS).alias("minute")).agg(F.min("run").alias("r0"), F.max("run").alias("r1"))
    left = stretches.filter(~F.coalesce(renewed, F.lit(False))).withColumn("minute", F.explode(F.sequence(F.floor(F.col("ct") / BUCKET_MS), F.floor((F.col("ct") + window_ms) / BUCKET_MS))))
    left = left.join(begun, ["scope_key", "minute"]).withColumn("begins", F.explode(F.sequence("r0", "r1"))).filter(F.col("begins") > F.col("run")).select(*columns, F.col("begins").alias("run"))
    latest = F.row_number().over(Window.partitionBy("scope_key", "run").orderBy(F.desc("ct"), F.desc("event_id")))
    start = held.unionByName(left).withColumn("rk", latest).filter(F.col("rk") <= neighbours + size).drop("rk").withColumns({"status": F.lit(None).cast("string"), "arrives": F.lit(False)})
    rows = alerts.select(*columns, "run", "status", F.lit(True).alias("arrives")).unionByName(start)
    return rows.select("scope_key", "run", "arrives", "ct", "event_id", "inc", "cf", "status")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("scope_key", "run").sortWithinPartitions("scope_key", "run", "arrives", "ct", "event_id")


def observations(ordinary: DataFrame, window_ms: int = WINDOW_MS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """An alert with the incidents of its scope that were active and had arrived within the window before it (itself among
    them), latest arrivals first, at most neighbours: event_id, ct, cf, scope_key, ci, ni, nf, rk, part (t: arrival, f: fired).

    A scope's alerts are cut into runs of RUN alerts, each a group of its own, however many arrive in a minute. A run is
    folded with its incidents in order of arrival, so an alert costs as much as it observes, whatever else is active.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, present = None, {}
        for frame in frames:
            out: list[tuple] = []
            for scope, number, arrives, at, event, inc, fired, status in frame.itertuples(index=False, name=None):
                if (scope, number) != key:
                    key, present = (scope, number), {}
                present.pop(inc, None)
                if arrives and status == "resolved":
                    continue
                present[inc] = (at, fired)  # the latest comes last
                if arrives:
                    for rank, name in enumerate(itertools.islice(reversed(present), neighbours), 1):
                        seen, when = present[name]
                        if seen < at - window_ms:
                            break
                        out.append((event, at, fired, scope, inc, name, when, rank, number // PARTS))
            yield pd.DataFrame(out, columns=["event_id", "ct", "cf", "scope_key", "ci", "ni", "nf", "rk", "part"])

    return _sorted(_runs(ordinary, RUN, window_ms, neighbours)).mapInPandas(run, "event_id long, ct long, cf long, scope_key string, ci string, ni string, nf long, rk int, part long")


def rounds(present: dict[str, tuple[int, int]], inc: str, at: int, fired: int) -> Iterator[tuple[str, str, str]]:
    """src, dst, other of an alert's rounds with the incidents present (name to arrival and time fired, the latest last; inc is the last)."""
    low, names = at - WINDOW_MS, itertools.islice(reversed(present.items()), NEIGHBOURS)
    next(names)
    for name, (seen, when) in names:
        if seen < low:
            return
        yield (name, inc, name) if when <= fired else (inc, name, name)


def parts_of(ordinary: DataFrame, nodes: bool = False, cut_ms: int | None = None, size: int = RUN * PARTS) -> DataFrame:
    """partial() of the edges (scope_key, src, dst) and, with nodes, of the nodes (src, dst is null), without their observations
    as rows: an alert makes up to NEIGHBOURS of them, a part has a row for each edge. Parts are those of observations(), twice
    over: 2 * part of what had arrived by cut_ms, 2 * part + 1 of the rest, so that both what was then and what is now are
    merged from one table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["scope_key", "src", "dst", "part", "w", "span", "first_cf", "last_cf", "m"]
        key, present, found, late = None, {}, {}, False

        def closed() -> pd.DataFrame:
            rows = [(key[0], src, dst, 2 * key[1] + late, *x) for (src, dst), x in found.items()]
            return pd.DataFrame(rows, columns=names)

        def count(name: tuple[str, str | None], fired: int) -> None:
            row = found.get(name)
            if row is None:
                found[name] = [1.0, 0, fired, fired, 1]
                return
            step = fired - row[3]
            if step > 0:
                row[0] *= math.exp(step * _RATE)
                row[1] += step
            row[0] += 1.0
            row[3] = fired
            row[4] += 1

        for frame in frames:
            for scope, number, arrives, at, _, inc, fired, status in frame.itertuples(index=False, name=None):
                if (scope, number) != key:
                    if found:
                        yield closed()
                    key, present, found, late = (scope, number), {}, {}, False
                present.pop(inc, None)
                if arrives and status == "resolved":
                    continue
                present[inc] = (at, fired)
                if not arrives:
                    continue
                if not late and cut_ms is not None and at > cut_ms:
                    if found:
                        yield closed()
                    found, late = {}, True
                if nodes:
                    count((inc, None), fired)
                for src, dst, other in rounds(present, inc, at, fired):
                    count((src, dst), fired)
                    if nodes:
                        count((other, None), fired)
        if found:
            yield closed()

    rows = _sorted(_runs(ordinary, size, WINDOW_MS, NEIGHBOURS))
    return rows.mapInPandas(run, "scope_key string, src string, dst string, part long, w double, span long, first_cf long, last_cf long, m long")


def edges_of(parts: DataFrame) -> DataFrame:
    """edges() of parts_of()."""
    return merged(parts.filter("dst IS NOT NULL"), ["scope_key", "src", "dst"]).select("scope_key", "src", "dst", F.col("w").alias("weight"), F.col("last_cf").alias("last_seen_ms"), F.col("m").alias("n"))


def nodes_of(parts: DataFrame) -> DataFrame:
    """node_stats() of parts_of() with nodes."""
    nodes = parts.filter("dst IS NULL").withColumnRenamed("src", "node")
    return merged(nodes, ["scope_key", "node"]).select("scope_key", "node", F.col("w").alias("observations"), F.col("last_cf").alias("last_observed_ms"))


def partial(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, w, span, first_cf, last_cf, m of rows (ct, event_id: arrival; cf: its time): their weight as at the last
    row of the part, halved for each half-life that passed, and what it takes to age it further.

    Of n rows in order of arrival the k-th has aged by the sum of the elapsed times after it, each at least 0.
    """
    ordered = Window.partitionBy(*keys, "part").orderBy(F.desc("ct"), F.desc("event_id"))
    sliced = rows.select(*keys, "ct", "event_id", "cf", "part")
    sliced = sliced.withColumn("step", F.greatest(F.lit(0), F.coalesce(F.lag("cf").over(ordered) - F.col("cf"), F.lit(0))))
    sliced = sliced.withColumn("age", F.sum("step").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("ct", "event_id")
    return sliced.groupBy(*keys, "part").agg(F.sum(C.decay(F.lit(1.0), F.col("age"), HALF_LIFE)).alias("w"), F.max("age").alias("span"), F.min_by("cf", place).alias("first_cf"), F.max_by("cf", place).alias("last_cf"), F.count(F.lit(1)).alias("m"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w, span, first_cf, last_cf, m of the parts of a key in their order, as one part: merging is associative."""
    later = Window.partitionBy(*keys).orderBy(F.desc("part"))
    between = F.greatest(F.lit(0), F.lag("first_cf").over(later) - F.col("last_cf")) + F.lag("span").over(later)
    parts = parts.withColumn("step", F.coalesce(between, F.lit(0)))
    parts = parts.withColumn("age", F.sum("step").over(later.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys).agg(F.sum(C.decay(F.col("w"), F.col("age"), HALF_LIFE)).alias("w"), F.max(F.col("age") + F.col("span")).alias("span"), F.min_by("first_cf", "part").alias("first_cf"), F.max_by("last_cf", "part").alias("last_cf"), F.sum("m").alias("m"))


def decayed(rows: DataFrame, keys: list[str], value: str, latest: str) -> DataFrame:
    """keys, value, latest, n: one for each row, halved for each half-life that passes.

    Ages are summed within parts of a scope's alerts first, each a group of its own of bounded size, and then over the parts
    of a key: no key's rows meet in one task.
    """
    return merged(partial(rows, keys), keys).select(*keys, F.col("w").alias(value), F.col("last_cf").alias(latest), F.col("m").alias("n"))


def directed(observed: DataFrame, *also: str) -> DataFrame:
    """scope_key, src, dst, ct, event_id, cf, part of observations of two incidents: src had fired by the time dst did."""
    leads = F.col("nf") <= F.col("cf")
    return observed.filter("ni <> ci").select("scope_key", F.when(leads, F.col("ni")).otherwise(F.col("ci")).alias("src"), F.when(leads, F.col("ci")).otherwise(F.col("ni")).alias("dst"), "ct", "event_id", "cf", "part", *also)


def edges(observed: DataFrame) -> DataFrame:
    """scope_key, src, dst, weight, last_seen_ms, n."""
    return decayed(directed(observed), ["scope_key", "src", "dst"], "weight", "last_seen_ms")


def node_stats(observed: DataFrame) -> DataFrame:
    """scope_key, node, observations, last_observed_ms: in how many rounds a node took part."""
    return decayed(observed.withColumn("node", F.col("ni")), ["scope_key", "node"], "observations", "last_observed_ms").drop("n")


def scope_stats(ordinary: DataFrame) -> DataFrame:
    """scope_key, rounds, last_observed_ms, observed_revision: every alert that leaves its incident active is a round."""
    rows = numbered(ordinary).filter("status <> 'resolved'").withColumn("part", F.floor((F.col("pos") - 1) / (RUN * PARTS)))
    return decayed(rows, ["scope_key"], "rounds", "last_observed_ms").withColumnRenamed("n", "observed_revision")


def rank_candidates(incidents: DataFrame) -> DataFrame:
    """The most recent active incidents of each scope, within the window before its newest."""
    newest = Window.partitionBy("scope_key")
    live = incidents.withColumn("newest", F.max("last_ingested_ms").over(newest)).filter((F.col("status") != "RESOLVED") & (F.col("last_ingested_ms") >= F.col("newest") - WINDOW_MS))
    rank = F.row_number().over(newest.orderBy(F.col("last_ingested_ms").desc(), "incident_id"))
    return live.withColumn("rk", rank).filter(F.col("rk") <= NEIGHBOURS).select("scope_key", "incident_id", F.col("rk").cast("long").alias("rk"))


def among(edges_: DataFrame, candidates: DataFrame) -> DataFrame:
    """The edges with both ends among the candidates."""
    ends = candidates.select("scope_key", "incident_id")
    inside = edges_.join(ends.withColumnRenamed("incident_id", "src"), ["scope_key", "src"], "left_semi")
    return inside.join(ends.withColumnRenamed("incident_id", "dst"), ["scope_key", "dst"], "left_semi")


def node_lead(edges_: DataFrame, nodes: DataFrame | None, scopes: DataFrame | None) -> DataFrame:
    """For each node: outbound and inbound contributions (decayed weight times lift), support and mean lift."""
    reference = edges_.groupBy("scope_key").agg(F.max("last_seen_ms").alias("ref"))
    e = edges_.join(reference, "scope_key").withColumn("w", C.decay(F.col("weight"), F.col("ref") - F.col("last_seen_ms"), HALF_LIFE))
    if nodes is None:
        e = e.withColumn("lift", F.lit(1.0))
    else:
        side = lambda name: nodes.select("scope_key", F.col("node").alias(name), F.col("observations").alias(f"o_{name}"))
        e = e.join(side("src"), ["scope_key", "src"], "left").join(side("dst"), ["scope_key", "dst"], "left").join(scopes.select("scope_key", "rounds"), "scope_key", "left")
        e = e.withColumn("lift", C.lift(F.col("w"), F.col("rounds"), F.col("o_src"), F.col("o_dst")))
    e = e.withColumn("c", F.col("w") * F.col("lift"))
    # one pass: an edge counts outbound for its source and inbound for its target
    source = F.struct(F.col("src").alias("node"), F.col("c").alias("o"), F.lit(0.0).alias("i"), F.col("w").alias("s"), F.col("lift").alias("l"), F.lit(1).alias("k"))
    target = F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.col("c").alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("l"), F.lit(0).alias("k"))
    both = e.select("scope_key", F.explode(F.array(source, target)).alias("x")).select("scope_key", "x.*")
    summed = both.groupBy("scope_key", "node").agg(F.sum("o").alias("outbound"), F.sum("i").alias("inbound"), F.sum("s").alias("support"), F.sum("l").alias("lifts"), F.sum("k").alias("n_out"))
    return summed.withColumn("mean_lift", F.col("lifts") / F.greatest("n_out", F.lit(1)))


def root_cause(lead: DataFrame) -> DataFrame:
    """scope_key, leader, confidence, support, mean_lift of the scopes where one node clearly leads."""
    net = lead.withColumn("net", F.col("outbound") - F.col("inbound")).filter("n_out > 0 and net > 0")
    order = Window.partitionBy("scope_key").orderBy(F.col("net").desc(), F.col("node").desc())
    first = net.withColumns({"rk": F.row_number().over(order), "second": F.coalesce(F.lead("net").over(order), F.lit(0.0))}).filter("rk = 1")
    confidence = (F.col("net") - F.col("second")) / F.col("net") * F.least(F.lit(1.0), F.col("support") / FULL_SUPPORT)
    out = first.withColumns({"dominance": F.col("net") / F.col("outbound"), "confidence": confidence})
    clear = (F.col("support") >= MIN_SUPPORT) & (F.col("dominance") >= MIN_DOMINANCE) & (F.col("confidence") >= MIN_CONFIDENCE)
    return out.filter(clear).select("scope_key", F.col("node").alias("leader"), "confidence", "support", "mean_lift")


def hints(candidates: DataFrame, verdicts: DataFrame, incidents: DataFrame) -> DataFrame:
    """scope_key, incident_id, hint of every candidate: its scope's verdict, or null, which withdraws what was said before."""
    titled = verdicts.join(incidents.select(F.col("incident_id").alias("leader"), "title"), "leader", "left")
    label = F.coalesce(F.nullif("title", F.lit("")), F.col("leader"))
    said = titled.select("scope_key", F.concat(label, F.lit(" (confidence "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)")).alias("hint"))
    return candidates.select("scope_key", "incident_id").join(said, "scope_key", "left")


def strong_neighbours(edges_: DataFrame, active: DataFrame, least: float = STORM_WEIGHT) -> DataFrame:
    """scope_key, node, other, weight: of each active incident its strongest active neighbours in the scope, either way."""
    strong = among(edges_.filter(F.col("weight") >= least), active)
    both = strong.select("scope_key", F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(strong.select("scope_key", F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))
    best = both.groupBy("scope_key", "node", "other").agg(F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("scope_key", "node").orderBy(F.round("weight", 6).desc(), "other"))
    return best.withColumn("rk", rank).filter(F.col("rk") <= NEIGHBOURS).drop("rk")


def group_roots(edges_: DataFrame, members: DataFrame) -> DataFrame:
    """component, root (which most leads the others of its group, the least id of equals; null without inner edges), outbound."""
    at = lambda name: members.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
    inside = edges_.join(at("src"), "src").join(at("dst"), "dst").filter("c_src = c_dst")
    outbound = inside.groupBy(F.col("c_src").alias("component"), "src").agg(F.round(F.sum("weight"), 6).alias("outbound"))
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("outbound"), "src"))
    return outbound.withColumn("rk", first).filter("rk = 1").select("component", F.col("src").alias("root"), "outbound")


def components(strong: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, component (least node) of an edge table (src, dst): alternating stars, each round a table in the shared folder."""
    stars = written(strong.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        stars = written(small.filter("u <> v").distinct(), "stars")
        state = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
