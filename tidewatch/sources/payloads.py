"""Vendor payloads to alerts: three JSON shapes normalised to one row for each alert, with what is wrong with it.

Rows carry an errors array; a payload with any error is rejected as a whole (accepted is false for all of its rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pick

_ALERT = "struct<state:string,status:string,labels:map<string,string>,annotations:map<string,string>,message:string,startsAt:string,fingerprint:string>"
PROMETHEUS = f"struct<status:string,alerts:array<{_ALERT}>>"
GRAFANA = f"struct<state:string,status:string,alerts:array<{_ALERT}>>"
DATADOG = "struct<event:struct<id:bigint,title:string,text:string,alert_transition:string,priority:string,tags:array<string>,timestamp:string>>"
# Vendor words to ours.
TRANSITIONS = {"triggered": "firing", "recovered": "resolved"}
DATADOG_PRIORITIES = {"p1": "critical", "p2": "high", "p3": "medium", "p4": "low"}
GRAFANA_STATES = {"alerting": "firing", "firing": "firing", "ok": "resolved", "resolved": "resolved"}


def _label(labels: Column, *names: str) -> Column:
    """The first label that is present and not empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(labels, F.lit(n)), F.lit("")) for n in names))


def epoch_ms(value: Column) -> Column:
    """Milliseconds of a time given in seconds, in milliseconds (from 1e11 on), or in ISO form; null if none of these."""
    number = value.try_cast("double")
    iso = F.unix_millis(F.try_to_timestamp(value))
    return F.when(number.isNotNull(), F.when(F.abs(number) >= 1e11, number).otherwise(number * 1000).cast("long")).otherwise(iso)


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("accepted", F.count_if(F.size("errors") > 0).over(Window.partitionBy("payload_id")) == 0)


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(bad, what) for bad, what in checks)))


def prometheus(payloads: DataFrame) -> DataFrame:
    """payloads: payload_id, body (JSON)."""
    rows = payloads.select("payload_id", F.from_json("body", PROMETHEUS).alias("p")).select("payload_id", F.posexplode_outer("p.alerts").alias("pos", "a"))
    labels = F.coalesce(F.col("a.labels"), F.create_map().cast("map<string,string>"))
    name = F.coalesce(_label(labels, "alertname"), F.lit("unknown"))
    return _accepted(rows.select(
        "payload_id", "pos", F.coalesce(_label(labels, "service", "job"), F.lit("unknown")).alias("service"), name.alias("alertname"), F.coalesce(_label(labels, "severity"), F.lit("info")).alias("severity_raw"),
        F.when(F.col("a.status") == "resolved", "resolved").otherwise("firing").alias("status"), F.coalesce(_label(F.col("a.annotations"), "summary", "description"), name).alias("message"),
        epoch_ms(F.col("a.startsAt")).alias("fired_ms"), labels.alias("labels"), _errors((epoch_ms(F.col("a.startsAt")).isNull(), "startsAt")).alias("errors"),
    ))


def grafana(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("payload_id", F.from_json("body", GRAFANA).alias("p")).select("payload_id", F.posexplode_outer("p.alerts").alias("pos", "a"))
    labels = F.coalesce(F.col("a.labels"), F.create_map().cast("map<string,string>"))
    state = pick(F.lower(F.coalesce(F.nullif(F.col("a.state"), F.lit("")), F.col("a.status"))), GRAFANA_STATES)
    name = _label(labels, "alertname")
    text = lambda c: F.when(F.trim(c) != "", c)
    notes = F.col("a.annotations")
    return _accepted(rows.select(
        "payload_id", "pos", F.coalesce(_label(labels, "service", "service_name"), F.lit("unknown")).alias("service"), name.alias("alertname"), F.coalesce(_label(labels, "severity"), F.lit("info")).alias("severity_raw"), state.alias("status"),
        F.coalesce(text(F.col("a.message")), text(F.try_element_at(notes, F.lit("summary"))), text(F.try_element_at(notes, F.lit("description"))), text(F.try_element_at(notes, F.lit("message"))), name).alias("message"),
        epoch_ms(F.col("a.startsAt")).alias("fired_ms"), labels.alias("labels"),
        _errors((state.isNull(), "state"), (name.isNull(), "alertname"), (F.coalesce(F.trim("a.fingerprint"), F.lit("")) == "", "fingerprint"), (epoch_ms(F.col("a.startsAt")).isNull(), "startsAt")).alias("errors"),
    ))


def datadog(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("payload_id", F.from_json("body", DATADOG)["event"].alias("e"))
    # of equal keys the last tag holds; a tag without a colon has an empty value
    tags = F.transform(F.coalesce("e.tags", F.array().cast("array<string>")), lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), t.alias("t")))
    keyed = F.transform(tags, lambda p: F.struct(p["k"].alias("k"), F.when(F.contains(p["t"], F.lit(":")), F.substring(p["t"], F.length(p["k"]) + 2, F.length(p["t"]))).otherwise("").alias("v")))
    names = F.array_distinct(F.transform(keyed, lambda p: p["k"]))
    labels = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(keyed, lambda p: p["k"] == n), -1)["v"]))
    rows = rows.withColumn("labels", labels)
    env = F.try_element_at("labels", F.lit("env"))
    aliased = F.when(env.isNotNull() & (env != "") & ~F.map_contains_key("labels", "environment"), F.map_concat("labels", F.create_map(F.lit("environment"), env))).otherwise(F.col("labels"))
    status = pick(F.lower(F.trim("e.alert_transition")), TRANSITIONS)
    priority = F.lower(F.trim("e.priority"))
    return _accepted(rows.select(
        "payload_id", F.lit(0).alias("pos"), F.coalesce(_label(F.col("labels"), "service", "service_name"), F.lit("unknown")).alias("service"), F.col("e.title").alias("alertname"), F.coalesce(pick(priority, DATADOG_PRIORITIES), priority).alias("severity_raw"),
        status.alias("status"), F.col("e.text").alias("message"), epoch_ms(F.col("e.timestamp")).alias("fired_ms"), aliased.alias("labels"),
        _errors((status.isNull(), "alert_transition"), (F.coalesce(F.trim("e.title"), F.lit("")) == "", "title"), (epoch_ms(F.col("e.timestamp")).isNull(), "timestamp")).alias("errors"),
    ))
