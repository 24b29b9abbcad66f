"""Callbacks of providers and people, applied to incidents between the alerts that they fall among.

A callback's id counts once, at its first arrival, whatever came of it. What a callback does depends on the incident's state
when it arrives, and that is what the latest alert or resolution before it left: an alert leaves its incident acknowledged
or resolved, a resolution leaves it resolved whether or not it changed anything. So no fold over its own output is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .store import written

#: The trigger of each kind, and the channels that hear of a change unless they made it.
TRIGGERS = {"acknowledge": "ACKNOWLEDGE", "resolve": "RESOLVE"}
CHANNELS = ["slack", "pagerduty"]


def reconciled(alerts: DataFrame, callbacks: DataFrame) -> DataFrame:
    """alerts: inc, event_id, status, ingested_ms. callbacks: callback_id, inbound_id, incident_id, provider, kind, actor, source, detail, at_ms.

    callbacks with verdict (applied, duplicate, ignored), from_state, to_state and reason. At equal times alerts come first,
    then callbacks by callback_id.
    """
    place = F.struct("at_ms", "callback_id")
    callbacks = written(callbacks, "callbacks")
    first = callbacks.groupBy("inbound_id").agg(F.min(place).alias("first"))
    told = callbacks.join(first, "inbound_id").withColumn("copy", place != F.col("first")).drop("first")
    leaves = F.when(F.col("status") == "resolved", "RESOLVED").otherwise("ACKNOWLEDGED")
    arrived = alerts.select(F.col("inc").alias("incident_id"), F.col("ingested_ms").alias("at_ms"), F.lit(0).alias("turn"), F.col("event_id").alias("callback_id"), leaves.alias("leaves"))
    told = told.withColumns({"turn": F.lit(1), "leaves": F.when(~F.col("copy") & (F.col("kind") == "resolve"), "RESOLVED")})
    # dealt by a hash of the key, see storms
    merged = arrived.unionByName(told, allowMissingColumns=True).repartition(F.xxhash64("incident_id")).withColumn("__k", F.xxhash64("incident_id"))
    before = Window.partitionBy("__k", "incident_id").orderBy("at_ms", "turn", "callback_id").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumns({"known": F.coalesce(F.count_if(F.col("turn") == 0).over(before), F.lit(0)) > 0, "from_state": F.last("leaves", ignorenulls=True).over(before)}).filter("turn = 1")
    trigger = C.pick(F.col("kind"), TRIGGERS)
    after = C.transition(F.col("from_state"), trigger)
    reason = F.when(F.col("copy"), "replayed").when(trigger.isNull(), F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit(""))))
    reason = reason.when(~F.col("known"), "unknown incident").when(after.isNull(), F.concat(F.lit("no transition from "), "from_state"))
    out = merged.withColumn("reason", reason).withColumn("verdict", F.when(F.col("copy"), "duplicate").when(F.col("reason").isNotNull(), "ignored").otherwise("applied"))
    applied = F.col("verdict") == "applied"
    out = out.withColumns({"to_state": F.when(applied, after), "from_state": F.when(applied, F.col("from_state"))})
    out = out.withColumn("reason", F.coalesce("reason", F.concat("from_state", F.lit(" -> "), "to_state")))
    return out.select("callback_id", "inbound_id", "incident_id", "provider", "kind", "actor", "source", "detail", "at_ms", "verdict", "from_state", "to_state", "reason")


def provenance(verdicts: DataFrame) -> DataFrame:
    """incident_id and who first acknowledged and resolved it, when and how: the first that says something wins, field by field."""
    place = F.struct("at_ms", "callback_id")
    first = lambda name, kind, what: F.min_by(what, F.when((F.col("kind") == kind) & F.col(what).isNotNull(), place)).alias(name)
    rows = verdicts.filter("verdict = 'applied'")
    return rows.groupBy("incident_id").agg(
        first("acknowledged_ms", "acknowledge", "at_ms"), first("acknowledged_by", "acknowledge", "actor"), first("acknowledged_via", "acknowledge", "provider"),
        first("resolved_ms", "resolve", "at_ms"), first("resolved_via", "resolve", "provider"), first("resolution_source", "resolve", "source"), first("resolution_detail", "resolve", "detail"),
    )


def intents(verdicts: DataFrame) -> DataFrame:
    """What goes out for each applied callback: every channel hears of it but the one it came from."""
    action = F.when(F.col("kind") == "resolve", "resolve").otherwise("update")
    rows = verdicts.filter("verdict = 'applied'").withColumn("channel", F.explode(F.array(*map(F.lit, CHANNELS)))).filter("channel <> provider")
    return rows.select("incident_id", "channel", action.alias("action"), F.concat_ws(":", F.lit("external"), "inbound_id", "channel").alias("idempotency_key"))


def after_callbacks(incidents: DataFrame, alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """incidents with the status that their latest alert or applied callback leaves."""
    last_alert = alerts.groupBy(F.col("inc").alias("incident_id")).agg(F.max("ingested_ms").alias("alert_ms"))
    last = verdicts.filter("verdict = 'applied'").groupBy("incident_id").agg(F.max_by("to_state", F.struct("at_ms", "callback_id")).alias("told"), F.max("at_ms").alias("told_ms"))
    rows = incidents.join(last_alert, "incident_id").join(last, "incident_id", "left")
    return rows.withColumn("status", F.when(F.col("told_ms") >= F.col("alert_ms"), F.col("told")).otherwise(F.col("status"))).drop("alert_ms", "told", "told_ms")
