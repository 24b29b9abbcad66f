"""Identity, classification, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import incidents as I
from .duck import ALERTS, INCIDENTS, RHYTHM
from .registry import add, sql

LABELS = "'cluster='||cluster||',environment='||environment||',pod='||pod"

# identity and classification
add("scope_key", lambda f: f.alerts().select("event_id", "scope_key"), "SELECT event_id, scope_key FROM alerts", ALERTS)
add("severity_final", lambda f: f.alerts().groupBy("severity_raw", "severity").agg(F.count(F.lit(1)).alias("n")), "SELECT severity_raw, severity, count(*) AS n FROM alerts GROUP BY ALL", ALERTS)
add("critical_bypass", lambda f: f.alerts().select("event_id", F.coalesce("bypass", F.lit("-")).alias("reason")), "SELECT event_id, coalesce(bypass,'-') AS reason FROM alerts", ALERTS)
add("fingerprint", lambda f: f.alerts().select("event_id", C.fingerprint(F.col("service"), F.col("alertname"), F.col("labels")).alias("fingerprint")), f"SELECT event_id, sha256(service||'|'||alertname||'|'||{LABELS}) AS fingerprint FROM alerts", ALERTS)
add("stable_fingerprint", lambda f: f.alerts().select("event_id", C.stable_fingerprint(F.col("service"), F.col("alertname"), F.col("severity_raw"), F.col("labels")).alias("fp")),
    """SELECT event_id, sha256('{"alertname":"'||alertname||'","labels":{"cluster":"'||cluster||'","environment":"'||environment||'"},"service":"'||service||'","severity":"'||severity_raw||'"}') AS fp FROM alerts""", ALERTS)  # fmt: skip
add("stable_labels", lambda f: f.alerts().select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(C.stable_labels(F.col("labels")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels")),
    "SELECT event_id, 'cluster='||cluster||',environment='||environment AS labels FROM alerts", ALERTS)
add("dedupe_counts", lambda f: f.o().groupBy("scope_key", C.stable_fingerprint(F.col("service"), F.col("alertname"), F.col("severity_raw"), F.col("labels")).alias("fp")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 1).alias("duplicates")).drop("fp"),
    "SELECT scope_key, count(*) AS n, count(*)-1 AS duplicates FROM o GROUP BY scope_key, service, alertname, severity_raw", ALERTS)
add("delivery_intents", lambda f: f.alerts().select("event_id", F.when(F.col("bypass").isNotNull(), F.concat_ws(":", F.lit("critical"), "event_id", F.concat(F.lit("bypass|"), F.col("event_id").cast("string")), F.lit("pagerduty"))).otherwise(F.concat_ws(":", F.lit("card"), "event_id", "inc", F.lit("update"))).alias("idempotency_key")).distinct(),
    "SELECT DISTINCT event_id, CASE WHEN bypass IS NOT NULL THEN 'critical:'||event_id||':bypass|'||event_id||':pagerduty' ELSE 'card:'||event_id||':'||inc||':update' END AS idempotency_key FROM alerts", ALERTS)
add("fsm_transitions", lambda f: f.spark.createDataFrame([(s, t) for s in ("OPEN", "ACKNOWLEDGED", "QUIESCENT", "RESOLVED") for t in ("ACKNOWLEDGE", "QUIET_TIMEOUT", "QUIET_DEADLINE", "RESOLVE", "REOPEN")], "state string, event string").withColumn("next", F.coalesce(C.transition(F.col("state"), F.col("event")), F.lit("-"))),
    """SELECT state, event, CASE WHEN state='OPEN' AND event='ACKNOWLEDGE' THEN 'ACKNOWLEDGED' WHEN state='ACKNOWLEDGED' AND event IN ('QUIET_TIMEOUT','QUIET_DEADLINE') THEN 'QUIESCENT'
    WHEN state<>'RESOLVED' AND event='RESOLVE' THEN 'RESOLVED' WHEN state='RESOLVED' AND event='REOPEN' THEN 'OPEN' ELSE '-' END AS next
    FROM (SELECT unnest(['OPEN','ACKNOWLEDGED','QUIESCENT','RESOLVED']) AS state) CROSS JOIN (SELECT unnest(['ACKNOWLEDGE','QUIET_TIMEOUT','QUIET_DEADLINE','RESOLVE','REOPEN']) AS event)""")  # fmt: skip

# roll-ups
_ROLL = ["incident_id", "scope_key", "alert_count", "first_alert_ms", "last_alert_ms", "first_ingested_ms", "last_ingested_ms", "status", "severity", "title", "reopen_count"]
add("incidents_rollup", lambda f: f.incidents().select(*_ROLL), f"SELECT {', '.join(_ROLL)} FROM incidents", INCIDENTS)
sql("severity_mix", "SELECT severity, count(*) AS count, sum(alert_count) AS alerts, max(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS place FROM {incidents} GROUP BY severity",
    "SELECT severity, count(*) AS count, CAST(sum(alert_count) AS BIGINT) AS alerts, max(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS place FROM incidents GROUP BY severity", INCIDENTS, "incidents")
add("lifecycle_counts", lambda f: f.incidents().groupBy("status").count().join(F.broadcast(f.spark.createDataFrame([(s,) for s in ("OPEN", "ACKNOWLEDGED", "QUIESCENT", "RESOLVED")], "status string")), "status", "right").select("status", F.coalesce("count", F.lit(0)).alias("n")),
    "SELECT s.status, count(i.status) AS n FROM (SELECT unnest(['OPEN','ACKNOWLEDGED','QUIESCENT','RESOLVED']) AS status) s LEFT JOIN incidents i ON i.status=s.status GROUP BY s.status", INCIDENTS)
_SKEW = "CAST(fired_ms-ingested_ms AS BIGINT)"
add("clock_skew", lambda f: f.alerts().groupBy("source", "scope_key").agg(F.max_by(F.col("fired_ms") - F.col("ingested_ms"), F.struct("ingested_ms", "event_id")).alias("last_skew_ms"), F.max(F.abs(F.col("fired_ms") - F.col("ingested_ms"))).alias("max_abs_skew_ms"), F.count(F.lit(1)).alias("samples")),
    f"SELECT source, scope_key, arg_max({_SKEW}, {{'t': ingested_ms, 'e': event_id}}) AS last_skew_ms, max(abs({_SKEW})) AS max_abs_skew_ms, count(*) AS samples FROM alerts GROUP BY ALL", ALERTS)
add("distinct_services", lambda f: f.o().select("scope_key", "service").distinct(), "SELECT DISTINCT scope_key, service FROM o", ALERTS)
add("distinct_fps", lambda f: f.alerts().groupBy("scope_key").agg(F.countDistinct("inc").alias("n")), "SELECT scope_key, count(DISTINCT inc) AS n FROM alerts GROUP BY scope_key", ALERTS)


def _buckets(n: int, f):
    inc = f.incidents().select("first_alert_ms", "alert_count")
    ends = inc.agg(F.min("first_alert_ms").alias("lo"), F.max("first_alert_ms").alias("hi"))
    size = F.greatest(F.lit(1), F.col("hi") - F.col("lo")) / F.lit(n)
    counted = inc.join(F.broadcast(ends)).groupBy(F.least(F.lit(n - 1), F.floor((F.col("first_alert_ms") - F.col("lo")) / size)).cast("int").alias("bucket")).agg(F.sum("alert_count").alias("ingested"), F.count(F.lit(1)).alias("consolidated"))
    return f.spark.range(n).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("ingested", F.lit(0)).alias("ingested"), F.coalesce("consolidated", F.lit(0)).alias("consolidated"))


def _bucket_sql(n: int, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT CAST(unnest(range({n})) AS INT) AS bucket) b LEFT JOIN (
      SELECT least({n - 1}, CAST(floor((first_alert_ms-lo)/(greatest(1,hi-lo)/CAST({n} AS DOUBLE))) AS INT)) AS bucket, sum(alert_count) AS ingested, count(*) AS consolidated
      FROM incidents, (SELECT min(first_alert_ms) AS lo, max(first_alert_ms) AS hi FROM incidents) GROUP BY 1) c USING (bucket)"""


add("volume_histogram", lambda f: _buckets(8, f).select("bucket", F.col("ingested").alias("alerts")), _bucket_sql(8, "bucket, CAST(coalesce(ingested,0) AS BIGINT) AS alerts"), INCIDENTS)
add("consolidation_series", lambda f: _buckets(12, f), _bucket_sql(12, "bucket, CAST(coalesce(ingested,0) AS BIGINT) AS ingested, coalesce(consolidated,0) AS consolidated"), INCIDENTS)
# joins and latest rows
add("incident_context", lambda f: f.incidents().join(f.o().groupBy("inc").agg(F.max_by("message", F.struct("ingested_ms", "event_id")).alias("message"), F.max_by("source", F.struct("ingested_ms", "event_id")).alias("source")), F.col("incident_id") == F.col("inc")).select("incident_id", "title", "message", "source"),
    "SELECT incident_id, title, l.message, l.source FROM incidents JOIN (SELECT inc, arg_max(message, seq) AS message, arg_max(source, seq) AS source FROM o GROUP BY inc) l ON l.inc=incident_id", INCIDENTS)
add("asof_prev_alert", lambda f: I.gaps(f.o()).select("event_id", "prev_ms", "prev_status"), "SELECT event_id, prev_ms, prev_status FROM og", INCIDENTS)
add("upsert_latest_per_key", lambda f: f.alerts().groupBy("source", "service").agg(F.max_by(F.struct("event_id", "status", "fired_ms"), F.struct("ingested_ms", "event_id")).alias("r")).select("source", "service", "r.*"),
    "SELECT source, service, event_id, status, fired_ms FROM (SELECT *, row_number() OVER (PARTITION BY source, service ORDER BY ingested_ms DESC, event_id DESC) AS rn FROM alerts) WHERE rn=1", ALERTS)
add("insert_or_ignore_first", lambda f: f.alerts().withColumn("rn", F.row_number().over(Window.partitionBy("inc").orderBy("ingested_ms", "event_id"))).select("event_id", (F.col("rn") == 1).cast("int").alias("inserted")),
    "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY inc ORDER BY ingested_ms, event_id)=1 THEN 1 ELSE 0 END AS inserted FROM alerts", ALERTS)

# windows and rhythm
add("alert_gaps", lambda f: I.gaps(f.o()).select("event_id", "gap"), "SELECT event_id, greatest(0, fired_ms-prev_ms) AS gap FROM og WHERE prev_ms IS NOT NULL UNION ALL SELECT event_id, NULL FROM og WHERE prev_ms IS NULL", INCIDENTS)
add("ewma_prefix", lambda f: I.rhythm(f.o()).select("event_id", F.round("mean_ms", 3).alias("mean_ms"), F.round(F.sqrt("variance"), 2).alias("deviation")), "SELECT event_id, round(mean_ms,3) AS mean_ms, round(sqrt(variance),2) AS deviation FROM dl", RHYTHM)
add("quiet_deadline", lambda f: I.rhythm(f.o()).select("event_id", "quiet_at_ms"), "SELECT event_id, quiet_at_ms FROM dl", RHYTHM)
add("reopen_count", lambda f: I.gaps(f.o()).select("event_id", F.sum(((F.col("prev_status") == "resolved") & (F.col("status") != "resolved")).cast("int")).over(Window.partitionBy("inc").orderBy("ingested_ms", "event_id")).cast("long").alias("reopens")).withColumn("reopens", F.coalesce("reopens", F.lit(0))),
    "SELECT event_id, CAST(sum(CASE WHEN prev_status='resolved' AND status<>'resolved' THEN 1 ELSE 0 END) OVER (PARTITION BY inc ORDER BY seq) AS BIGINT) AS reopens FROM og", INCIDENTS)
# sorting and top-k
add("noisiest", lambda f: f.incidents().orderBy(F.desc("alert_count"), "incident_id").limit(5).select("incident_id", "alert_count"), "SELECT incident_id, alert_count FROM incidents ORDER BY alert_count DESC, incident_id LIMIT 5", INCIDENTS)
add("snapshot_incidents", lambda f: f.incidents().orderBy(F.desc("last_ingested_ms"), "incident_id").limit(100).select("incident_id", "status", "alert_count"), "SELECT incident_id, status, alert_count FROM incidents ORDER BY last_ingested_ms DESC, incident_id LIMIT 100", INCIDENTS)
# event-time windows
_T = lambda: F.timestamp_millis("fired_ms")
add("alerts_tumbling", lambda f: f.alerts().groupBy(F.window(_T(), "15 minutes").alias("w"), "alertname").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("start_ms"), "alertname", "n"), "SELECT fired_ms//900000*900000 AS start_ms, alertname, count(*) AS n FROM alerts GROUP BY ALL", ALERTS)
add("alerts_sliding", lambda f: f.alerts().groupBy(F.window(_T(), "30 minutes", "15 minutes").alias("w"), "scope_key").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("start_ms"), "scope_key", "n"), "SELECT fired_ms//900000*900000 - s AS start_ms, scope_key, count(*) AS n FROM alerts, (SELECT unnest([0,900000]) AS s) GROUP BY ALL", ALERTS)
# Spark joins what is exactly the gap apart, the SQL parts it: a millisecond less is the same in whole milliseconds
add("alert_sessions", lambda f: f.alerts().groupBy("user_id", F.session_window(_T(), "299999 milliseconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_millis("w.start").alias("start_ms"), "n"),
    "SELECT user_id, min(fired_ms) AS start_ms, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY fired_ms, event_id) AS ep FROM (SELECT *, CASE WHEN fired_ms-lag(fired_ms) OVER (PARTITION BY user_id ORDER BY fired_ms, event_id) < 300000 THEN 0 ELSE 1 END AS brk FROM alerts)) GROUP BY user_id, ep", ALERTS)
