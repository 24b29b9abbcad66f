"""Queries of storms as arriving alerts build them up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from ..operators import storms as S
from .duck import EDGES
from .registry import Frames, query

#: Every alert asks for the strong edges of its incident at that moment; groups are the components of all links.
STORMS = (
    EDGES.replace("ev AS", "RECURSIVE ev AS", 1)
    + """,
eh0 AS MATERIALIZED (SELECT *, sum(d) OVER (PARTITION BY src, dst ORDER BY cs ROWS UNBOUNDED PRECEDING) AS age, lead(cs) OVER (PARTITION BY src, dst ORDER BY cs) AS until FROM (
  SELECT *, greatest(0, coalesce(ct - lag(ct) OVER (PARTITION BY src, dst ORDER BY cs), 0)) AS d FROM obs)),
eh AS MATERIALIZED (SELECT a.src, a.dst, a.cs, a.until, round(sum(exp(-ln(2.0)*(a.age-b.age)/3600000.0)), 9) AS weight FROM eh0 a JOIN eh0 b ON a.src=b.src AND a.dst=b.dst AND b.cs<=a.cs GROUP BY ALL),
side AS MATERIALIZED (SELECT node, other, cs, until, weight FROM (SELECT src AS node, dst AS other, cs, until, weight FROM eh UNION ALL SELECT dst, src, cs, until, weight FROM eh) WHERE weight>=1.5),
asked AS MATERIALIZED (SELECT o.seq, o.event_id, o.ingested_ms, o.inc AS node, other, max(weight) AS weight FROM o JOIN side s ON s.node=o.inc AND s.cs<=o.seq AND (s.until IS NULL OR o.seq<s.until) GROUP BY ALL),
link AS MATERIALIZED (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.seq ORDER BY round(weight,6) DESC, other) AS rk FROM asked a ASOF JOIN o s ON s.inc=a.other AND s.seq<=a.seq WHERE s.status<>'resolved') WHERE rk<=25),
und AS MATERIALIZED (SELECT node AS a, other AS b FROM link UNION SELECT other, node FROM link),
reach(a, b) AS (SELECT DISTINCT a, a FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a=r.b),
comp AS MATERIALIZED (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
born AS (SELECT component, min(seq) AS seq FROM link JOIN comp USING (node) GROUP BY component),
party AS (SELECT component, event_id, ingested_ms, unnest([node, other]) AS incident_id FROM born JOIN link USING (seq)),
birth AS (SELECT component, any_value(event_id) AS formed_event, any_value(ingested_ms) AS formed_ms, arg_min(incident_id, {'t': first_alert_ms, 'n': incident_id}) AS group_id FROM party JOIN incidents USING (incident_id) GROUP BY component),
member AS MATERIALIZED (SELECT node AS incident_id, group_id, formed_event, formed_ms FROM comp JOIN birth USING (component))"""
)


def _links(f: Frames) -> DataFrame:
    return f.kept("links", lambda: S.links_of(f.settled(), edge_parts(f)))


def edge_parts(f: Frames) -> DataFrame:
    return f.kept("edge_parts", lambda: G.parts_of(f.settled()))


def members(f: Frames) -> DataFrame:
    return f.kept("members", lambda: S.storm_members(_links(f), f.kept("incidents", f.incidents)))


@query("storm_links", "SELECT count(DISTINCT node||'>'||other) AS pairs, count(DISTINCT node) AS incidents FROM (SELECT node, other FROM link UNION SELECT other, node FROM link)", STORMS)
def storm_links(f: Frames) -> DataFrame:
    """How many incidents were ever joined, and in how many pairs (both ways)."""
    both = _links(f).select(F.explode(F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other")))).alias("x")).select("x.*").distinct()
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("node").alias("incidents"))


@query("storm_members", "SELECT * FROM member", STORMS)
def storm_members(f: Frames) -> DataFrame:
    """The storm of each incident that ever joined one, by its anchor, with the alert that formed it."""
    return members(f)


@query(
    "storm_groups",
    """SELECT g.group_id, g.scope_key, formed_event, formed_ms, members, g.severity, g.status, x.root, t.title||' (+'||(members-1)||' correlated)' AS title FROM (
    SELECT group_id, any_value(scope_key) AS scope_key, any_value(formed_event) AS formed_event, any_value(formed_ms) AS formed_ms, count(*) AS members,
      arg_min(severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS severity,
      CASE WHEN bool_or(status<>'RESOLVED') THEN 'OPEN' ELSE 'RESOLVED' END AS status, arg_min(incident_id, {'t': first_alert_ms, 'n': incident_id}) AS first FROM member JOIN incidents USING (incident_id) GROUP BY group_id) g
    LEFT JOIN (SELECT group_id, src FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY outbound DESC, src) AS rk FROM (
      SELECT a.group_id, src, round(sum(weight),6) AS outbound FROM edges JOIN member a ON a.incident_id=src JOIN member b ON b.incident_id=dst AND a.group_id=b.group_id GROUP BY ALL)) WHERE rk=1) r ON r.group_id=g.group_id
    CROSS JOIN LATERAL (SELECT coalesce(r.src, g.first) AS root) x JOIN incidents t ON t.incident_id=x.root""",
    STORMS,
)
def storm_groups(f: Frames) -> DataFrame:
    """Each storm with its fixed anchor and what its members make of it now: resolved once all are, titled by the root."""
    rank = C.pick(F.col("severity"), C.PRIORITIES, 9)
    return S.storm_facts(members(f), f.kept("incidents", f.incidents), f.kept("edges", lambda: G.edges_of(edge_parts(f))), rank).select("group_id", "scope_key", "formed_event", "formed_ms", "members", "severity", "status", "root", "title")
