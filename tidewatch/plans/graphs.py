"""Graph queries. One function per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from .duck import EDGES
from .registry import Frames, query

ACTIVE = "SELECT incident_id FROM incidents WHERE status<>'RESOLVED'"
#: The background ranker's period.
SWEEP_MS = 2000


def _active(f: Frames) -> DataFrame:
    return f.incidents().filter("status <> 'RESOLVED'")


@query("cooccurrence_pairs", "SELECT event_id, CASE WHEN nf<=ct THEN ni ELSE ci END AS src, CASE WHEN nf<=ct THEN ci ELSE ni END AS dst, rk FROM act WHERE ni<>ci", EDGES)
def cooccurrence_pairs(f: Frames) -> DataFrame:
    leads = F.col("nf") <= F.col("cf")
    return f.observed().filter("ni <> ci").select("event_id", F.when(leads, F.col("ni")).otherwise(F.col("ci")).alias("src"), F.when(leads, F.col("ci")).otherwise(F.col("ni")).alias("dst"), F.col("rk").cast("long").alias("rk"))


@query("edges_decayed", "SELECT src, dst, round(weight,4) AS weight, last_seen_ms FROM edges", EDGES)
def edges_decayed(f: Frames) -> DataFrame:
    return f.edges().select("src", "dst", F.round("weight", 4).alias("weight"), "last_seen_ms")


@query("node_stats", "SELECT node, scope_key, round(observations,4) AS observations, last_observed_ms FROM nodes", EDGES)
def node_stats(f: Frames) -> DataFrame:
    return f.nodes().select("node", "scope_key", F.round("observations", 4).alias("observations"), "last_observed_ms")


@query("scope_stats", "SELECT scope_key, round(rounds,4) AS rounds, last_observed_ms, observed_revision FROM scopes", EDGES)
def scope_stats(f: Frames) -> DataFrame:
    return f.scopes().select("scope_key", F.round("rounds", 4).alias("rounds"), "last_observed_ms", "observed_revision")


def revisions(rows: DataFrame) -> DataFrame:
    """scope_key, observed_revision, ranked_revision: rounds by now (the newest arrival), and those that the last sweep before it saw."""
    now = rows.agg(F.max("ingested_ms").alias("now_ms"))  # one row
    rounds = rows.filter("status <> 'resolved'").join(F.broadcast(now))
    swept = F.floor((F.col("now_ms") - 1) / SWEEP_MS) * SWEEP_MS
    return rounds.groupBy("scope_key").agg(F.count(F.lit(1)).alias("observed_revision"), F.count_if(F.col("ingested_ms") <= swept).alias("ranked_revision"))


REVISIONS = f"""(SELECT scope_key, count(*) AS observed_revision, count(*) FILTER (WHERE ingested_ms <= (now_ms-1)//{SWEEP_MS}*{SWEEP_MS}) AS ranked_revision
    FROM o, (SELECT max(ingested_ms) AS now_ms FROM o) WHERE status<>'resolved' GROUP BY scope_key)"""


@query("dirty_scopes", f"SELECT * FROM {REVISIONS} WHERE ranked_revision < observed_revision", EDGES)
def dirty_scopes(f: Frames) -> DataFrame:
    """Scopes with rounds that the last sweep of the ranker has not seen."""
    return revisions(f.o()).filter("ranked_revision < observed_revision")


@query(
    "active_edges_topn",
    f"SELECT src, dst, last_seen_ms FROM edges WHERE src IN ({ACTIVE}) AND dst IN ({ACTIVE}) ORDER BY last_seen_ms DESC, src, dst LIMIT 500",
    EDGES,
)
def active_edges_topn(f: Frames) -> DataFrame:
    return G.among(f.edges(), _active(f)).orderBy(F.desc("last_seen_ms"), "src", "dst").limit(500).select("src", "dst", "last_seen_ms")


@query("edges_recent", "SELECT src, dst, last_seen_ms FROM edges ORDER BY last_seen_ms DESC, src, dst LIMIT 200", EDGES)
def edges_recent(f: Frames) -> DataFrame:
    return f.edges().orderBy(F.desc("last_seen_ms"), "src", "dst").limit(200).select("src", "dst", "last_seen_ms")


_STRONG = f"""(SELECT node, other, weight FROM (SELECT node, other, weight, row_number() OVER (PARTITION BY node ORDER BY round(weight,6) DESC, other) AS rk FROM (
    SELECT node, other, max(weight) AS weight FROM (SELECT src AS node, dst AS other, weight FROM edges WHERE weight>=1.5 UNION ALL SELECT dst, src, weight FROM edges WHERE weight>=1.5)
    WHERE other IN ({ACTIVE}) AND node IN ({ACTIVE}) GROUP BY ALL)) WHERE rk<=25)"""


@query("strong_neighbours", f"SELECT node, other, round(weight,4) AS weight FROM {_STRONG}", EDGES)
def strong_neighbours(f: Frames) -> DataFrame:
    edges = f.kept("edges", f.edges)
    return G.strong_neighbours(edges, _active(f)).select("node", "other", F.round("weight", 4).alias("weight"))


_BOTH = "(SELECT src AS incident_id, src, dst, weight, last_seen_ms FROM edges UNION ALL SELECT dst, src, dst, weight, last_seen_ms FROM edges)"


@query("edges_for_incident", f"SELECT incident_id, src, dst, round(weight,4) AS weight, row_number() OVER (PARTITION BY incident_id ORDER BY last_seen_ms DESC, src, dst) AS place FROM {_BOTH}", EDGES)
def edges_for_incident(f: Frames) -> DataFrame:
    """Every incident's edges in either direction, newest first."""
    rows = f.edges().withColumn("incident_id", F.explode(F.array("src", "dst")))
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("last_seen_ms"), "src", "dst"))
    return rows.select("incident_id", "src", "dst", F.round("weight", 4).alias("weight"), place.cast("long").alias("place"))


@query(
    "causes_effects",
    """SELECT dst AS incident_id, 'cause' AS role, a.title, round(weight,4) AS weight FROM edges JOIN incidents a ON a.incident_id=src
    UNION ALL SELECT src, 'effect', b.title, round(weight,4) FROM edges JOIN incidents b ON b.incident_id=dst""",
    EDGES,
)
def causes_effects(f: Frames) -> DataFrame:
    """Of every incident what led to it and what it led to, by title."""
    edge = F.array(F.struct(F.col("dst").alias("incident_id"), F.lit("cause").alias("role"), F.col("src").alias("other")), F.struct(F.col("src").alias("incident_id"), F.lit("effect").alias("role"), F.col("dst").alias("other")))
    rows = f.edges().select(F.explode(edge).alias("x"), F.round("weight", 4).alias("weight")).select("x.*", "weight")
    return rows.join(f.incidents().select(F.col("incident_id").alias("other"), "title"), "other").select("incident_id", "role", "title", "weight")


@query("graph_nodes", "SELECT src AS node FROM edges UNION SELECT dst FROM edges", EDGES)
def graph_nodes(f: Frames) -> DataFrame:
    return f.edges().select(F.explode(F.array("src", "dst")).alias("node")).distinct()


_CAND = """,
cand AS (SELECT scope_key, incident_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY last_ingested_ms DESC, incident_id) AS rk FROM (
    SELECT *, max(last_ingested_ms) OVER (PARTITION BY scope_key) AS newest FROM incidents) WHERE status<>'RESOLVED' AND last_ingested_ms>=newest-900000) WHERE rk<=25)"""
_LEAD = (
    EDGES
    + _CAND
    + """,
ce AS (SELECT * FROM edges WHERE src IN (SELECT incident_id FROM cand) AND dst IN (SELECT incident_id FROM cand)),
ref AS (SELECT scope_key, max(last_seen_ms) AS ref FROM ce GROUP BY scope_key),
dec AS (SELECT e.*, weight*exp(-ln(2.0)*(ref-last_seen_ms)/3600000.0) AS w FROM ce e JOIN ref USING (scope_key)),
lif AS (SELECT d.*, CASE WHEN {unit} OR coalesce(rounds,0)<=0 OR coalesce(a.observations,0)<=0 OR coalesce(b.observations,0)<=0 THEN 1.0 ELSE least(w*rounds/(a.observations*b.observations), 4.0) END AS lift
  FROM dec d LEFT JOIN nodes a ON a.node=d.src LEFT JOIN nodes b ON b.node=d.dst LEFT JOIN scopes s ON s.scope_key=d.scope_key),
outb AS (SELECT scope_key, src AS node, sum(w*lift) AS outbound, sum(w) AS support, avg(lift) AS mean_lift FROM lif GROUP BY ALL),
inb AS (SELECT scope_key, dst AS node, sum(w*lift) AS inbound FROM lif GROUP BY ALL),
lead_ AS (SELECT o2.*, coalesce(inbound,0) AS inbound FROM outb o2 LEFT JOIN inb USING (scope_key, node)),
net AS (SELECT *, outbound-inbound AS net FROM lead_ WHERE outbound-inbound>0),
top AS (SELECT *, row_number() OVER w1 AS rk, coalesce(lead(net) OVER w1, 0) AS second FROM net WINDOW w1 AS (PARTITION BY scope_key ORDER BY net DESC, node DESC)),
verdict AS (SELECT *, (net-second)/net*least(1.0, support/6.0) AS confidence FROM top WHERE rk=1 AND support>=1.5 AND net/outbound>=0.25 AND (net-second)/net*least(1.0, support/6.0)>=0.35)"""
)
LIFTED, UNLIFTED = _LEAD.replace("{unit}", "false"), _LEAD.replace("{unit}", "true")


def _lead(f: Frames, lifted: bool = True) -> DataFrame:
    f.settled()
    candidates = f.kept("candidates", lambda: G.rank_candidates(f.incidents()))
    parts = f.kept("parts", lambda: G.parts_of(f.settled(), lifted))
    # of each scope a few nodes are in question: their rounds alone are merged
    edges = G.edges_of(G.among(parts, candidates))
    if not lifted:
        return G.node_lead(edges, None, None)
    nodes = parts.join(candidates.select("scope_key", F.col("incident_id").alias("src")), ["scope_key", "src"], "left_semi")
    return G.node_lead(edges, G.nodes_of(nodes), f.scopes())


def _verdicts(f: Frames, lifted: bool = True) -> DataFrame:
    return G.root_cause(_lead(f, lifted))


_VERDICT = "SELECT scope_key, node AS leader, round(confidence,4) AS confidence, round(support,3) AS support, round(mean_lift,4) AS mean_lift FROM verdict"


def _rounded(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("scope_key", "leader", F.round("confidence", 4).alias("confidence"), F.round("support", 3).alias("support"), F.round("mean_lift", 4).alias("mean_lift"))


@query("rank_candidates", "SELECT scope_key, incident_id, rk FROM cand", EDGES + _CAND)
def rank_candidates(f: Frames) -> DataFrame:
    return G.rank_candidates(f.incidents())


@query("node_lead", "SELECT scope_key, node, round(outbound,3) AS outbound, round(inbound,3) AS inbound, round(support,3) AS support, round(mean_lift,4) AS mean_lift FROM lead_", LIFTED)
def node_lead(f: Frames) -> DataFrame:
    lead = _lead(f).filter("n_out > 0")
    return lead.select("scope_key", "node", F.round("outbound", 3).alias("outbound"), F.round("inbound", 3).alias("inbound"), F.round("support", 3).alias("support"), F.round("mean_lift", 4).alias("mean_lift"))


@query("root_cause", _VERDICT, LIFTED)
def root_cause(f: Frames) -> DataFrame:
    """The verdict over each scope's candidates and the edges between them."""
    return _rounded(_verdicts(f))


@query("root_cause_nolift", _VERDICT, UNLIFTED)
def root_cause_nolift(f: Frames) -> DataFrame:
    return _rounded(_verdicts(f, lifted=False))


def hints_at(f: Frames, until_ms: int | None = None) -> DataFrame:
    """scope_key, incident_id, hint as a ranking over the alerts that had arrived by until_ms leaves them."""
    if until_ms is None:
        return G.hints(G.rank_candidates(f.incidents()), _verdicts(f), f.incidents())
    return hints_at(_Until(f, f.settled().filter(F.col("ingested_ms") <= until_ms)))


class _Until(Frames):
    """The model's tables of the alerts so far."""

    def __init__(self, f: Frames, rows: DataFrame):
        super().__init__(f.spark, f.sf_dir)
        self._rows = rows

    def o(self) -> DataFrame:
        return self._rows

    def settled(self) -> DataFrame:
        return self._rows  # of a table as it is


@query(
    "scope_hints",
    """SELECT incident_id, t.title||' (confidence '||CAST(CAST(round(confidence*100) AS INT) AS VARCHAR)||'%)' AS hint FROM cand LEFT JOIN verdict v ON v.scope_key=cand.scope_key
    LEFT JOIN (SELECT incident_id AS node, title FROM incidents) t ON t.node=v.node""",
    LIFTED,
)
def scope_hints(f: Frames) -> DataFrame:
    """The hint of every candidate, null where its scope has no clear cause."""
    return hints_at(f).select("incident_id", "hint")


@query("hint_changes")
def hint_changes(f: Frames) -> DataFrame:
    """Hints that the ranking of now writes over those of a window ago: new, other, or withdrawn (null). Equal ones are left.

    The history is folded once: what it was a window ago is merged from the parts up to then.
    """
    now = f.settled().agg(F.max("ingested_ms")).first()[0]
    if now is None:
        return hints_at(f).select("incident_id", "hint")
    until = now - G.WINDOW_MS
    parts = f.kept("parts", lambda: G.parts_of(f.settled(), True, until))
    then = _Until(f, f.settled().filter(F.col("ingested_ms") <= until))
    then.kept("parts", lambda: parts.filter("part % 2 = 0"))
    before = hints_at(then).select("incident_id", F.col("hint").alias("old"))
    return hints_at(f).join(before, "incident_id", "left").filter(~F.col("hint").eqNullSafe(F.col("old"))).select("incident_id", "hint")


_STORM = (
    EDGES.replace("ev AS", "RECURSIVE ev AS", 1)
    + f""",
und AS (SELECT node AS a, other AS b FROM {_STRONG} UNION SELECT other, node FROM {_STRONG}),
reach(a, b) AS (SELECT DISTINCT a, a FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a=r.b),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""
)


def _storms(f: Frames) -> DataFrame:
    edges = f.kept("edges", f.edges)
    links = G.strong_neighbours(edges, _active(f)).select(F.col("node").alias("src"), F.col("other").alias("dst"))
    return f.kept("storms", lambda: G.components(links))


@query("storm_components", "SELECT node, component FROM comp", _STORM)
def storm_components(f: Frames) -> DataFrame:
    """Active incidents of a scope that are tied by repeated co-occurrence."""
    return _storms(f)


@query("storm_anchor", "SELECT component, arg_min(node, {'t': first_alert_ms, 'n': node}) AS anchor, count(*) AS members FROM comp JOIN incidents ON incident_id=node GROUP BY component", _STORM)
def storm_anchor(f: Frames) -> DataFrame:
    members = _storms(f).join(f.incidents().select(F.col("incident_id").alias("node"), "first_alert_ms"), "node")
    return members.groupBy("component").agg(F.min(F.struct("first_alert_ms", "node"))["node"].alias("anchor"), F.count(F.lit(1)).alias("members"))


@query(
    "group_rollup",
    """SELECT component, arg_min(severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS severity,
    CASE WHEN bool_or(status<>'RESOLVED') THEN 'OPEN' ELSE 'RESOLVED' END AS status, count(*) AS members, CAST(sum(alert_count) AS BIGINT) AS alerts FROM comp JOIN incidents ON incident_id=node GROUP BY component""",
    _STORM,
)
def group_rollup(f: Frames) -> DataFrame:
    members = _storms(f).join(f.incidents(), F.col("incident_id") == F.col("node"))
    return members.groupBy("component").agg(
        F.min_by("severity", C.pick(F.col("severity"), C.PRIORITIES, 9)).alias("severity"),
        F.when(F.bool_or(F.col("status") != "RESOLVED"), "OPEN").otherwise("RESOLVED").alias("status"),
        F.count(F.lit(1)).alias("members"),
        F.sum("alert_count").alias("alerts"),
    )


ROOTS = """SELECT m.component, coalesce(r.src, m.first) AS root, coalesce(r.outbound, 0) AS outbound, t.title||' (+'||(m.members-1)||' correlated)' AS title FROM (
    SELECT component, count(*) AS members, arg_min(node, {'t': first_alert_ms, 'n': node}) AS first FROM comp JOIN incidents ON incident_id=node GROUP BY component) m
    LEFT JOIN (SELECT component, src, outbound FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY outbound DESC, src) AS rk FROM (
      SELECT a.component, src, round(sum(weight),6) AS outbound FROM edges JOIN comp a ON a.node=src JOIN comp b ON b.node=dst AND a.component=b.component GROUP BY ALL)) WHERE rk=1) r ON r.component=m.component
    JOIN incidents t ON t.incident_id=coalesce(r.src, m.first)"""


@query("group_root", ROOTS, _STORM)
def group_root(f: Frames) -> DataFrame:
    """Each storm's root, what it leads by, and the storm's title."""
    storms = _storms(f)
    first = storms.join(f.incidents().select(F.col("incident_id").alias("node"), "first_alert_ms"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("first_alert_ms", "node"))["node"].alias("first"))
    rooted = first.join(G.group_roots(f.kept("edges", f.edges), storms), "component", "left").withColumn("root", F.coalesce("root", "first"))
    titled = rooted.join(f.incidents().select(F.col("incident_id").alias("root"), "title"), "root")
    title = F.concat("title", F.lit(" (+"), (F.col("members") - 1).cast("string"), F.lit(" correlated)"))
    return titled.select("component", "root", F.coalesce("outbound", F.lit(0.0)).alias("outbound"), title.alias("title"))


@query(
    "group_snapshot",
    "SELECT component, string_agg(DISTINCT s, ',' ORDER BY s) AS services FROM comp JOIN (SELECT inc, arg_min(service, seq) AS s FROM o GROUP BY inc) ON inc=node GROUP BY component",
    _STORM,
)
def group_snapshot(f: Frames) -> DataFrame:
    first = f.o().groupBy(F.col("inc").alias("node")).agg(F.min_by("service", F.struct("ingested_ms", "event_id")).alias("service"))
    return _storms(f).join(first, "node").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"))




@query(
    "dominant_edges",
    "SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY least(src,dst), greatest(src,dst) ORDER BY round(weight,6) DESC, src) AS rk FROM edges) WHERE rk=1",
    EDGES,
)
def dominant_edges(f: Frames) -> DataFrame:
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.round("weight", 6).desc(), "src")
    return f.edges().withColumn("rk", F.row_number().over(pair)).filter("rk = 1").select("src", "dst")


@query("decay_math", "SELECT id, round(8.0*exp(-ln(2.0)*id*600000/3600000.0),8) AS decayed, round(8.0*exp(-ln(2.0)*id*600000/3600000.0)+1,8) AS increased FROM (SELECT unnest(range(50)) AS id)")
def decay_math(f: Frames) -> DataFrame:
    value = C.decay(F.lit(8.0), F.col("id") * 600000)
    return f.spark.range(50).select("id", F.round(value, 8).alias("decayed"), F.round(value + 1, 8).alias("increased"))


def checked_decay(rows: DataFrame) -> DataFrame:
    """value decayed by elapsed, or what is wrong: a number that is not finite, or one below 0."""
    v, t = F.col("value"), F.col("elapsed")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    error = F.when(bad(v) | bad(t), "not finite").when((v < 0) | (t < 0), "negative")
    return rows.withColumn("error", error).withColumn("decayed", F.when(F.col("error").isNull(), C.decay(v, t)))


@query(
    "decay_validation",
    """SELECT id, CASE WHEN id%5 IN (0,1) THEN 'not finite' WHEN id%5=2 THEN 'negative' WHEN id%5=3 THEN 'negative' END AS error,
    CASE WHEN id%5=4 THEN round(id*exp(-ln(2.0)*1000*id/3600000.0),8) END AS decayed FROM (SELECT unnest(range(50)) AS id)""",
)
def decay_validation(f: Frames) -> DataFrame:
    turn = F.col("id") % 5
    value = F.when(turn == 0, F.lit(float("nan"))).when(turn == 2, F.lit(-1.0)).otherwise(F.col("id").cast("double"))
    elapsed = F.when(turn == 1, F.lit(float("inf"))).when(turn == 3, F.lit(-5.0)).otherwise(F.col("id") * 1000.0)
    return checked_decay(f.spark.range(50).select("id", value.alias("value"), elapsed.alias("elapsed"))).select("id", "error", F.round("decayed", 8).alias("decayed"))
