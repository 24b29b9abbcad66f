"""Payload sources and ingest authorisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import pick
from ..sources import payloads as P
from .duck import ALERTS
from .registry import add, query, sql

_ISO = lambda: F.date_format(F.timestamp_millis("fired_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _prom(f):
    """Three alerts to a payload; some without a start."""
    alert = F.struct(F.col("status"), F.map_concat("labels", F.create_map(F.lit("service"), "service", F.lit("alertname"), "alertname", F.lit("severity"), "severity_raw")).alias("labels"), F.create_map(F.lit("summary"), "message").alias("annotations"), F.when(F.col("event_id") % 101 != 7, _ISO()).alias("startsAt"))
    bodies = f.alerts().groupBy((F.col("event_id") / 3).cast("long").alias("payload_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.to_json(alert).alias("a")))).alias("x"))
    return P.prometheus(bodies.select("payload_id", F.concat(F.lit('{"alerts":['), F.array_join(F.transform("x", lambda e: e["a"]), ","), F.lit("]}")).alias("body")))


def _graf(f):
    alert = F.struct(F.when(F.col("status") == "firing", "Alerting").otherwise("OK").alias("state"), F.map_concat("labels", F.create_map(F.lit("service_name"), "service", F.lit("alertname"), "alertname")).alias("labels"), F.lit(" ").alias("message"), F.create_map(F.lit("description"), "message").alias("annotations"), _ISO().alias("startsAt"), F.when(F.col("event_id") % 53 != 3, "fp").alias("fingerprint"))
    return P.grafana(f.alerts().select(F.col("event_id").alias("payload_id"), F.to_json(F.struct(F.array(alert).alias("alerts"))).alias("body")))


def _dog(f):
    tags = F.array(F.concat(F.lit("env:"), F.element_at("labels", "environment")), F.lit("service:old"), F.concat(F.lit("service:"), "service"), F.lit("flag"))
    event = F.struct(F.col("event_id").alias("id"), F.col("alertname").alias("title"), F.col("message").alias("text"), F.when(F.col("status") == "firing", "Triggered").when(F.col("event_id") % 9 == 0, "Unknown").otherwise("Recovered").alias("alert_transition"), F.concat(F.lit("P"), (F.col("k") % 4 + 1).cast("string")).alias("priority"), tags.alias("tags"), (F.when(F.col("event_id") % 2 == 0, F.col("fired_ms")).otherwise(F.floor(F.col("fired_ms") / 1000))).cast("string").alias("timestamp"))
    return P.datadog(f.alerts().select(F.col("event_id").alias("payload_id"), F.to_json(F.struct(event.alias("event"))).alias("body")))


add("src_prometheus", lambda f: _prom(f).select("payload_id", "pos", "service", "alertname", "severity_raw", "status", "message", "fired_ms", "accepted"),
    """SELECT payload_id, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY event_id)-1 AS INT) AS pos, service, alertname, severity_raw, status, message, CASE WHEN event_id%101<>7 THEN fired_ms END AS fired_ms, bool_and(event_id%101<>7) OVER (PARTITION BY payload_id) AS accepted
    FROM (SELECT *, event_id//3 AS payload_id FROM alerts)""", ALERTS)  # fmt: skip
add("src_grafana", lambda f: _graf(f).select("payload_id", "service", "alertname", "severity_raw", "status", "message", "fired_ms", "accepted"), "SELECT event_id AS payload_id, service, alertname, 'info' AS severity_raw, status, message, fired_ms, event_id%53<>3 AS accepted FROM alerts", ALERTS)
add("src_datadog", lambda f: _dog(f).select("payload_id", "service", "alertname", "severity_raw", "status", "fired_ms", F.element_at("labels", "environment").alias("environment"), F.element_at("labels", "flag").alias("flag"), "accepted"),
    """SELECT event_id AS payload_id, service, alertname, ['critical','high','medium','low'][CAST(k%4 AS INT)+1] AS severity_raw, CASE WHEN status='firing' THEN 'firing' WHEN event_id%9=0 THEN NULL ELSE 'resolved' END AS status,
    CASE WHEN event_id%2=0 THEN fired_ms ELSE fired_ms//1000*1000 END AS fired_ms, environment, '' AS flag, NOT (status<>'firing' AND event_id%9=0) AS accepted FROM alerts""", ALERTS)  # fmt: skip
add("ingest_reject", lambda f: _prom(f).filter("not accepted").select("payload_id").distinct(), "SELECT DISTINCT event_id//3 AS payload_id FROM alerts WHERE event_id%101=7", ALERTS)
add("ts_decode_epoch", lambda f: f.alerts().select("event_id", P.epoch_ms(F.when(F.col("event_id") % 3 == 0, F.col("fired_ms").cast("string")).when(F.col("event_id") % 3 == 1, F.floor(F.col("fired_ms") / 1000).cast("string")).otherwise(_ISO())).alias("ms")), "SELECT event_id, CASE WHEN event_id%3=1 THEN fired_ms//1000*1000 ELSE fired_ms END AS ms FROM alerts", ALERTS)
TOKENS = "prom:t1:production/*,dog:t2:*,broken,graf:t3:staging/c1,:x,open:t4"


def _tokens(spark):
    parts = F.split("entry", ":", 3)
    rows = spark.createDataFrame([(TOKENS,)], "raw string").select(F.explode(F.split("raw", ",")).alias("entry")).select(F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("token"), F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(2))), F.lit("")), F.lit("*")).alias("scope"))
    return rows.filter("coalesce(name, '') <> '' AND coalesce(token, '') <> ''")


add("parse_tokens", lambda f: _tokens(f.spark), "SELECT unnest(['prom','dog','graf','open']) AS name, unnest(['t1','t2','t3','t4']) AS token, unnest(['production/*','*','staging/c1','*']) AS scope")
#: Nine alerts to a posted batch.
BATCH = 9


def authorised(alerts, tokens_):
    """alerts (with batch and token) and the name of the token that may post them: a scope of *, or a prefix before a *. One
    alert outside its token's scope vetoes the whole batch."""
    # the parsed setting: a row for each configured token
    known = alerts.join(F.broadcast(tokens_), "token", "left")
    allowed = F.coalesce((F.col("scope") == "*") | F.expr("startswith(scope_key, rtrim('*', scope))"), F.lit(False))
    return known.withColumn("ok", F.min(allowed).over(Window.partitionBy("batch"))).filter("ok")


@query(
    "ingest_scope_filter",
    f"""SELECT event_id, name FROM (SELECT *, bool_and(fits) OVER (PARTITION BY batch) AS ok FROM (SELECT event_id, event_id//{BATCH}*3+event_id%3 AS batch, CASE source WHEN 'prometheus' THEN 'prom' WHEN 'datadog' THEN 'dog' ELSE 'graf' END AS name,
    source='datadog' OR (source='prometheus' AND starts_with(scope_key,'production/')) OR (source='grafana' AND starts_with(scope_key,'staging/c1')) AS fits FROM alerts)) WHERE ok""",
    ALERTS,
)
def ingest_scope_filter(f):
    """Batches of one source each that their token may post as a whole."""
    token = pick(F.col("source"), {"prometheus": "t1", "datadog": "t2", "grafana": "t3"})
    batch = F.expr(f"event_id div {BATCH}") * 3 + F.col("event_id") % 3
    return authorised(f.alerts().select("event_id", "scope_key", token.alias("token"), batch.alias("batch")), _tokens(f.spark)).select("event_id", "name")


# Parts of names that are secret, and one that is although it does not say so.
SENSITIVE, SENSITIVE_NAMES = ["TOKEN", "SECRET", "PASSWORD", "KEY", "CREDENTIAL"], ["HEARTBEAT_URL"]


def redacted(name, value):
    """A setting's value as it may be shown: secret ones are not, unless they are empty."""
    upper = F.upper(name)
    secret = upper.isin(SENSITIVE_NAMES) | upper.rlike("|".join(SENSITIVE))
    return F.when(secret & (F.coalesce(value, F.lit("")) != ""), "***redacted***").otherwise(value)


_SETTINGS = [("API_TOKEN", "a"), ("PORT", "80"), ("db_password", "b"), ("HOST", "c"), ("heartbeat_url", "https://h"), ("HEARTBEAT_URLS", "n"), ("GITHUB_CREDENTIALS", "d"), ("EMPTY_KEY", ""), ("NO_SECRET", None)]


@query("redact_settings", "SELECT * FROM (VALUES ('API_TOKEN','***redacted***'),('PORT','80'),('db_password','***redacted***'),('HOST','c'),('heartbeat_url','***redacted***'),('HEARTBEAT_URLS','n'),('GITHUB_CREDENTIALS','***redacted***'),('EMPTY_KEY',''),('NO_SECRET',NULL)) AS t(name, value)")
def redact_settings(f):
    return f.spark.createDataFrame(_SETTINGS, "name string, value string").select("name", redacted(F.col("name"), F.col("value")).alias("value"))


_REL = "CASE WHEN s<5 THEN 'just now' WHEN s<60 THEN concat(s,'s ago') WHEN m<60 THEN concat(m,'m ago') WHEN h<24 THEN concat(h,'h ago') ELSE concat(d,'d ago') END"
_REL_SQL = "SELECT event_id, {rel} AS ago FROM (SELECT *, CAST(floor(h/24.0+0.5) AS BIGINT) AS d FROM (SELECT *, CAST(floor(m/60.0+0.5) AS BIGINT) AS h FROM (SELECT *, CAST(floor(s/60.0+0.5) AS BIGINT) AS m FROM (SELECT event_id, CAST(floor((1704180000000-fired_ms)/1000.0+0.5) AS BIGINT) AS s FROM {t}) w) x) y) z"
sql("relative_time", _REL_SQL.format(rel=_REL, t="{alerts}"), _REL_SQL.format(rel=_REL, t="alerts"), ALERTS, "alerts")
