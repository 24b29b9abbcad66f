"""Delivery queue, breaker, self-check, ledger and stream queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import folds
from .duck import ALERTS, INCIDENTS, OUTBOX
from .registry import add, sql

NOW = 1704090000000

add("outbox_priority", lambda f: f.outbox().select("outbox_id", "priority", (F.col("priority") <= 1).cast("int").alias("worthy")), "SELECT outbox_id, priority, CASE WHEN priority<=1 THEN 1 ELSE 0 END AS worthy FROM outbox", OUTBOX)
add("outbox_batch", lambda f: f.outbox().filter(f"status = 'pending' AND next_attempt_ms <= {NOW}").orderBy("priority", "outbox_id").limit(10).select("outbox_id", "priority"), f"SELECT outbox_id, priority FROM outbox WHERE status='pending' AND next_attempt_ms<={NOW} ORDER BY priority, outbox_id LIMIT 10", OUTBOX)
add("outbox_claim", lambda f: f.outbox().filter(f"status = 'pending' AND next_attempt_ms <= {NOW} AND (locked_until_ms IS NULL OR locked_until_ms < {NOW}) AND channel IN ('slack','email')").orderBy("priority", "outbox_id").limit(10).select("outbox_id", F.lit(NOW + 60000).alias("locked_until_ms")),
    f"SELECT outbox_id, {NOW + 60000} AS locked_until_ms FROM outbox WHERE status='pending' AND next_attempt_ms<={NOW} AND (locked_until_ms IS NULL OR locked_until_ms<{NOW}) AND channel IN ('slack','email') ORDER BY priority, outbox_id LIMIT 10", OUTBOX)
_BY_CHANNEL = lambda: Window.partitionBy("channel").orderBy("priority", "outbox_id")
add("half_open_trim", lambda f: f.outbox().filter("status = 'pending'").withColumn("rn", F.row_number().over(_BY_CHANNEL())).filter("rn <= 3").select("channel", "outbox_id"), "SELECT channel, outbox_id FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY priority, outbox_id) AS rn FROM outbox WHERE status='pending') WHERE rn<=3", OUTBOX)
add("queue_depth", lambda f: f.outbox().groupBy("channel", "status").count().withColumnRenamed("count", "n"), "SELECT channel, status, count(*) AS n FROM outbox GROUP BY ALL", OUTBOX)


def _coalesced(f):
    pending = f.outbox().filter("status = 'pending'")
    # aggregated before the join, so a hot incident is no one task's work
    winners = pending.groupBy("incident_id", "channel").agg(F.max("outbox_id").alias("winner"), F.max_by("via", F.when(F.col("via").isNotNull(), F.col("outbox_id"))).alias("carried"))
    return pending.join(winners, ["incident_id", "channel"]).select("outbox_id", F.when(F.col("outbox_id") < F.col("winner"), "superseded").otherwise("pending").alias("status"), F.when(F.col("outbox_id") < F.col("winner"), F.col("winner")).alias("superseded_by"), F.when(F.col("outbox_id") == F.col("winner"), F.coalesce("carried", "via")).otherwise(F.col("via")).alias("via"))


add("coalesce_pending", _coalesced, """SELECT outbox_id, CASE WHEN outbox_id<winner THEN 'superseded' ELSE 'pending' END AS status, CASE WHEN outbox_id<winner THEN winner END AS superseded_by,
    CASE WHEN outbox_id=winner THEN coalesce(carried, via) ELSE via END AS via FROM (SELECT *, max(outbox_id) OVER w AS winner, arg_max(via, CASE WHEN via IS NOT NULL THEN outbox_id END) OVER w AS carried FROM outbox WHERE status='pending' WINDOW w AS (PARTITION BY incident_id, channel))""", OUTBOX)  # fmt: skip
add("effective_action", lambda f: f.outbox().join(f.incidents().select("incident_id", F.col("status").alias("live")), "incident_id", "left").select("outbox_id", F.when(F.col("live") == "RESOLVED", "resolve").otherwise(F.col("action")).alias("action")), "SELECT outbox_id, CASE WHEN i.status='RESOLVED' THEN 'resolve' ELSE action END AS action FROM outbox LEFT JOIN incidents i USING (incident_id)", OUTBOX)
add("failover_select", lambda f: _failover(f.outbox()), "SELECT outbox_id, channel, CASE channel WHEN 'slack' THEN 'email' WHEN 'pagerduty' THEN 'slack' END AS target FROM outbox", OUTBOX)


def _failover(outbox, available=("email", "slack")):
    chain = F.split(C.pick(F.col("channel"), {k: ",".join(v) for k, v in C.FAILOVER.items()}, ""), ",")
    return outbox.select("outbox_id", "channel", F.get(F.filter(chain, lambda c: c.isin(*available)), F.lit(0)).alias("target"))


_SIG = f"SELECT count_if(status='pending') AS pending, count_if(status='dead') AS dead, {NOW}-min(CASE WHEN status='pending' THEN created_ms END) AS oldest_ms FROM"
sql("outbox_signals", f"{_SIG} {{outbox}}", f"SELECT count(*) FILTER (WHERE status='pending') AS pending, count(*) FILTER (WHERE status='dead') AS dead, {NOW}-min(CASE WHEN status='pending' THEN created_ms END) AS oldest_ms FROM outbox", OUTBOX, "outbox")


add("external_ref_map", lambda f: f.outbox().filter("external_ref IS NOT NULL").groupBy("channel", "external_ref").agg(F.max_by("incident_id", "outbox_id").alias("incident_id")), "SELECT channel, external_ref, arg_max(incident_id, outbox_id) AS incident_id FROM outbox WHERE external_ref IS NOT NULL GROUP BY ALL", OUTBOX)
add("inbound_dedup", lambda f: f.outbox().filter("external_ref IS NOT NULL").groupBy("external_ref").agg(F.min("outbox_id").alias("applied"), (F.count(F.lit(1)) - 1).alias("replays")), "SELECT external_ref, min(outbox_id) AS applied, count(*)-1 AS replays FROM outbox WHERE external_ref IS NOT NULL GROUP BY ALL", OUTBOX)
add("external_fanout", lambda f: f.outbox().filter("external_ref IS NOT NULL").select("outbox_id", "channel", F.explode(F.array(*map(F.lit, ["slack", "pagerduty", "email"]))).alias("target")).filter("target <> channel").select("outbox_id", "target"), "SELECT outbox_id, target FROM outbox, (SELECT unnest(['slack','pagerduty','email']) AS target) WHERE external_ref IS NOT NULL AND target<>channel", OUTBOX)
add("pd_projection", lambda f: f.outbox().select("outbox_id", C.pick(F.col("priority"), {0: "critical", 1: "error", 2: "warning", 3: "info"}, "info").alias("severity"), C.pick(F.col("action"), {"create": "trigger", "update": "acknowledge", "resolve": "resolve"}).alias("event_action")),
    "SELECT outbox_id, CASE priority WHEN 0 THEN 'critical' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, CASE action WHEN 'create' THEN 'trigger' WHEN 'update' THEN 'acknowledge' ELSE action END AS event_action FROM outbox", OUTBOX)
add("backoff_schedule", lambda f: f.spark.range(0, 12).select(F.col("id").cast("int").alias("n"), C.retry_backoff(F.col("id")).alias("retry_s"), C.probe_delay(F.col("id")).alias("probe_s")), "SELECT n, CAST(least(pow(2.0,n),300) AS BIGINT) AS retry_s, CAST(least(5*pow(2.0,n),120) AS BIGINT) AS probe_s FROM (SELECT CAST(unnest(range(12)) AS INT) AS n)")
