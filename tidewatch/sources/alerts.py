"""The alert stream of a data directory: alerts are derived from its events, in compressed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

EPOCH = 1704067200000


def read_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_from(spark.read.parquet(f"{sf_dir}/events.parquet"))


def alerts_from(events: DataFrame) -> DataFrame:
    """Alerts of an events table (batch or streaming)."""
    k = F.get_json_object("props", "$.k").cast("int")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    base = events.select("event_id", "user_id", "event_type", k.alias("k"), ms.alias("ms"))
    source = F.element_at(F.array(*map(F.lit, ["prometheus", "datadog", "grafana"])), (F.col("event_id") % 3 + 1).cast("int"))
    service = F.element_at(F.array(*map(F.lit, ["checkout", "auth", "database", "catalog"])), (F.col("user_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("k") >= 97, "critical").when(F.col("k") >= 80, "error").when(F.col("k") >= 40, "warning").otherwise("info")
    fired = F.expr(f"{EPOCH} + (ms - {EPOCH}) div 60")
    message = F.when(F.col("event_type") == "error", "requests failed").when(F.col("k") % 17 == 0, "pages corrupt").otherwise(F.concat("event_type", F.lit(" degraded")))
    environment = F.when(F.col("user_id") % 2 == 0, "production").otherwise("staging")
    cluster = F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))
    out = base.select(
        "event_id", "user_id", "k", source.alias("source"), service.alias("service"), F.col("event_type").alias("alertname"), raw.alias("severity_raw"),
        F.when(F.col("k") % 10 == 9, "resolved").otherwise("firing").alias("status"), message.alias("message"), fired.alias("fired_ms"),
        F.create_map(F.lit("cluster"), cluster, F.lit("environment"), environment, F.lit("pod"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string"))).alias("labels"),
    )
    late = F.when(F.col("source") == "grafana", F.lit(180000)).otherwise(F.lit(0))
    out = out.withColumn("ingested_ms", F.col("fired_ms") + (F.col("event_id") * 7919) % 2000 + late)
    text = C.alert_text(F.col("service"), F.col("alertname"), F.col("message"), F.col("labels"))
    out = out.withColumns({"scope_key": C.scope_key(F.col("labels")), "severity": C.severity(F.col("severity_raw")), "bypass": C.critical_bypass(F.col("severity_raw"), F.col("labels"), text)})
    return out.withColumn("inc", F.concat_ws("|", "scope_key", "service", "alertname", "severity_raw"))


def ordinary(alerts: DataFrame) -> DataFrame:
    return alerts.filter("bypass IS NULL")
