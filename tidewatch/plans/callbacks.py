"""Queries of callbacks: what became of each, what they leave behind, and storms after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import callbacks as B
from ..operators import graph as G
from ..operators import storms as S
from .duck import OUTBOX
from .registry import Frames, query
from .storms import STORMS, edge_parts, members

#: Every posted row may be answered, up to seven minutes later; two rows share a delivery id, and some name no incident.
_TOLD = """,
told AS (SELECT outbox_id AS callback_id, channel||':'||(outbox_id//6) AS inbound_id, CASE WHEN outbox_id%17=0 THEN 'gone' ELSE incident_id END AS incident_id, channel AS provider,
  CASE WHEN k%4=0 THEN 'acknowledge' WHEN k%4=3 THEN 'note' ELSE 'resolve' END AS kind, CASE WHEN outbox_id%3<>0 THEN 'u'||(outbox_id%5) END AS actor,
  CASE WHEN outbox_id%7=0 THEN 'inferred_silence' ELSE 'operator' END AS source, CASE WHEN k%2=0 THEN 'd'||(k%10) END AS detail, created_ms + (outbox_id*1777)%420000 AS at_ms FROM outbox WHERE external_ref IS NOT NULL),
once AS (SELECT *, row_number() OVER (PARTITION BY inbound_id ORDER BY at_ms, callback_id)>1 AS copy FROM told),
mrg AS (SELECT inc AS incident_id, ingested_ms AS at_ms, 0 AS turn, event_id AS callback_id, CASE WHEN status='resolved' THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS leaves, CAST(NULL AS BOOLEAN) AS copy, CAST(NULL AS VARCHAR) AS kind FROM o
  UNION ALL SELECT incident_id, at_ms, 1, callback_id, CASE WHEN NOT copy AND kind='resolve' THEN 'RESOLVED' END, copy, kind FROM once),
st AS (SELECT *, count(*) FILTER (WHERE turn=0) OVER w AS alerts_before, last_value(leaves IGNORE NULLS) OVER w AS s FROM mrg WINDOW w AS (PARTITION BY incident_id ORDER BY at_ms, turn, callback_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
verdicts AS MATERIALIZED (SELECT t.callback_id, t.inbound_id, t.incident_id, t.provider, t.kind, t.actor, t.source, t.detail, t.at_ms,
  CASE WHEN st.copy THEN 'duplicate' WHEN t.kind='resolve' AND alerts_before>0 AND s<>'RESOLVED' THEN 'applied' ELSE 'ignored' END AS verdict,
  CASE WHEN st.copy THEN 'replayed' WHEN t.kind='note' THEN 'unknown kind: note' WHEN coalesce(alerts_before,0)=0 THEN 'unknown incident' WHEN t.kind='acknowledge' OR s='RESOLVED' THEN 'no transition from '||s ELSE s||' -> RESOLVED' END AS reason
  FROM told t JOIN st ON st.turn=1 AND st.callback_id=t.callback_id)"""
CALLBACKS = OUTBOX + _TOLD


def _callbacks(f: Frames) -> DataFrame:
    n, k = F.col("outbox_id"), F.col("k")
    text = lambda c: c.cast("string")
    return f.outbox().filter("external_ref IS NOT NULL").select(
        n.alias("callback_id"), F.concat_ws(":", "channel", text(F.expr("outbox_id div 6"))).alias("inbound_id"), F.when(n % 17 == 0, "gone").otherwise(F.col("incident_id")).alias("incident_id"), F.col("channel").alias("provider"),
        F.when(k % 4 == 0, "acknowledge").when(k % 4 == 3, "note").otherwise("resolve").alias("kind"), F.when(n % 3 != 0, F.concat(F.lit("u"), text(n % 5))).alias("actor"),
        F.when(n % 7 == 0, "inferred_silence").otherwise("operator").alias("source"), F.when(k % 2 == 0, F.concat(F.lit("d"), text(k % 10))).alias("detail"), (F.col("created_ms") + (n * 1777) % 420000).alias("at_ms"),
    )


def _verdicts(f: Frames) -> DataFrame:
    return f.kept("verdicts", lambda: B.reconciled(f.settled(), _callbacks(f)))


@query("reconcile_verdicts", "SELECT callback_id, incident_id, verdict, reason FROM verdicts", CALLBACKS)
def reconcile_verdicts(f: Frames) -> DataFrame:
    """Every callback with what became of it and why."""
    return _verdicts(f).select("callback_id", "incident_id", "verdict", "reason")


@query(
    "incident_provenance",
    """SELECT incident_id, arg_min(at_ms, {'t': at_ms, 'c': callback_id}) AS resolved_ms, arg_min(provider, {'t': at_ms, 'c': callback_id}) AS resolved_via, arg_min(source, {'t': at_ms, 'c': callback_id}) AS resolution_source,
    arg_min(detail, {'t': at_ms, 'c': callback_id}) FILTER (WHERE detail IS NOT NULL) AS resolution_detail FROM verdicts WHERE verdict='applied' GROUP BY incident_id""",
    CALLBACKS,
)
def incident_provenance(f: Frames) -> DataFrame:
    """Who resolved an incident first, and how; alerts acknowledge theirs themselves, so no callback does."""
    return B.provenance(_verdicts(f)).select("incident_id", "resolved_ms", "resolved_via", "resolution_source", "resolution_detail")


@query(
    "callback_intents",
    """SELECT incident_id, channel, 'resolve' AS action, 'external:'||inbound_id||':'||channel AS idempotency_key FROM verdicts, (SELECT unnest(['slack','pagerduty']) AS channel) WHERE verdict='applied' AND channel<>provider""",
    CALLBACKS,
)
def callback_intents(f: Frames) -> DataFrame:
    return B.intents(_verdicts(f))


@query(
    "storm_status_after_callbacks",
    """SELECT group_id, count(*) AS members, count(*) FILTER (WHERE s<>'RESOLVED') AS active, CASE WHEN bool_or(s<>'RESOLVED') THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM (
    SELECT group_id, CASE WHEN a.told_ms>=l.alert_ms THEN 'RESOLVED' ELSE i.status END AS s FROM member m JOIN incidents i USING (incident_id) JOIN (SELECT inc AS incident_id, max(ingested_ms) AS alert_ms FROM o GROUP BY inc) l USING (incident_id)
    LEFT JOIN (SELECT incident_id, max(at_ms) AS told_ms FROM verdicts WHERE verdict='applied' GROUP BY incident_id) a USING (incident_id)) GROUP BY group_id""",
    STORMS + OUTBOX[OUTBOX.index(",\noutbox AS") :] + _TOLD,
)
def storm_status_after_callbacks(f: Frames) -> DataFrame:
    """Storms as their members' callbacks leave them: over once every member is."""
    now = B.after_callbacks(f.kept("incidents", f.incidents), f.settled(), _verdicts(f))
    rank = C.pick(F.col("severity"), C.PRIORITIES, 9)
    facts = S.storm_facts(members(f), now, f.kept("edges", lambda: G.edges_of(edge_parts(f))), rank)
    active = members(f).join(now.filter("status <> 'RESOLVED'").select("incident_id"), "incident_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("active"))
    return facts.join(active, "group_id", "left").select("group_id", "members", F.coalesce("active", F.lit(0)).alias("active"), "status")
