"""State tables folded from the alert stream: incidents, gaps, deadlines, episodes.

Two clocks: alerts are taken in their order of arrival (ingest time, then id), whatever their own time says. Gaps between
an incident's alerts are measured on the source's clock, and a late alert's gap is 0; deadlines are set on ours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .prefixes import Prefixes

ARRIVAL = ["ingested_ms", "event_id"]


def _per_incident() -> Window:
    return Window.partitionBy("inc").orderBy(*ARRIVAL)


def gaps(ordinary: DataFrame) -> DataFrame:
    """ordinary with the previous arrival's status and source time, the gap (null for an incident's first alert) and its place."""
    w = _per_incident()
    out = ordinary.withColumns({"prev_status": F.lag("status").over(w), "prev_ms": F.lag("fired_ms").over(w), "place": F.row_number().over(w)})
    return out.withColumn("gap", F.when(F.col("prev_ms").isNotNull(), F.greatest(F.lit(0), F.col("fired_ms") - F.col("prev_ms"))))


def _weighted(rows: DataFrame) -> DataFrame:
    """rows of gaps() with n (all gaps of the incident) and what its final mean and variance are sums of.

    With n gaps the fold has alpha = 2 / (n + 1) throughout, and q = 1 - alpha to the power of n stays near exp(-2): the
    weights q ** -k neither vanish nor overflow, so the fold is a running sum, without arrays, however long the history.
    """
    w = _per_incident()
    k = F.col("place") - 1
    rows = rows.withColumn("n", F.count("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    alpha = F.lit(2.0) / (F.col("n") + 1)
    q = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise((F.col("n") - 1) / (F.col("n") + 1))
    rows = rows.withColumns({"alpha": alpha, "q": q})
    rows = rows.withColumn("share", F.when(k == 1, F.col("gap") / F.col("q")).when(k > 1, F.col("alpha") * F.pow("q", -k) * F.col("gap")))
    before = F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(k > 1, F.pow(F.col("gap") - F.pow("q", k - 1) * before, F.lit(2.0)))
    return rows.withColumn("scatter", F.col("alpha") * F.pow("q", F.col("n") - k + 1) * apart)


def incidents(ordinary: DataFrame) -> DataFrame:
    """One row for each (scope, stable identity): counts, times, state after the last arrival, reopens, rhythm and deadline."""
    last = F.struct(*ARRIVAL)
    grouped = _weighted(gaps(ordinary)).groupBy("inc").agg(
        F.first("scope_key").alias("scope_key"),
        F.first("service").alias("service"),
        F.first("alertname").alias("alertname"),
        F.first("severity").alias("severity"),
        F.max_by("message", last).alias("summary"),
        F.count(F.lit(1)).alias("alert_count"),
        F.min_by("fired_ms", last).alias("first_alert_ms"),
        F.max_by("fired_ms", last).alias("last_alert_ms"),
        F.min("ingested_ms").alias("first_ingested_ms"),
        F.max("ingested_ms").alias("last_ingested_ms"),
        F.max_by("status", last).alias("last_status"),
        F.count_if((F.col("prev_status") == "resolved") & (F.col("status") != "resolved")).alias("reopen_count"),
        F.count("gap").alias("n"),
        (F.pow(F.first("q"), F.count("gap")) * F.coalesce(F.sum("share"), F.lit(0.0))).alias("mean"),
        F.coalesce(F.sum("scatter"), F.lit(0.0)).alias("scatter"),
    )
    resolved = F.col("last_status") == "resolved"
    out = grouped.withColumns({"mean_gap": F.when(resolved, 0.0).otherwise(F.col("mean")), "variance": F.when(resolved, 0.0).otherwise(F.col("scatter"))})
    deadline = C.quiet_deadline(F.col("last_ingested_ms"), F.col("mean_gap"), F.col("variance"), F.col("n") > 1, F.col("first_ingested_ms"))
    return out.select(
        F.col("inc").alias("incident_id"),
        "scope_key",
        "service",
        "alertname",
        "severity",
        C.title(F.col("service"), F.col("alertname")).alias("title"),
        "summary",
        "alert_count",
        "first_alert_ms",
        "last_alert_ms",
        "first_ingested_ms",
        "last_ingested_ms",
        F.when(resolved, "RESOLVED").otherwise("ACKNOWLEDGED").alias("status"),
        "reopen_count",
        "mean_gap",
        "variance",
        F.when(~resolved, deadline).alias("quiet_at_ms"),
        F.when(F.col("severity") == "critical", "pagerduty").otherwise("slack").alias("route"),
    )


def rhythm(ordinary: DataFrame) -> DataFrame:
    """For each alert the gaps up to it folded into mean and variance, and the quiet deadline that follows.

    The first and second alert find no history and take the initial window; a resolved state has no deadline. Sorted
    partitions stream by: an incident's gaps go through Prefixes batch by batch, in linear time and bounded memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, prefixes = None, Prefixes()
        for frame in frames:
            incs, gap = frame["inc"].to_numpy(), frame["gap"].to_numpy(np.float64)
            mean, variance = np.zeros(len(frame)), np.zeros(len(frame))
            cuts = [0, *(np.flatnonzero(incs[1:] != incs[:-1]) + 1), len(frame)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if incs[start] != key:
                    # an incident's first alert has no gap
                    key, prefixes, start = incs[start], Prefixes(), start + 1
                mean[start:end], variance[start:end] = prefixes.take(gap[start:end])
            off = (frame["status"] == "resolved").to_numpy()
            few = frame["place"].to_numpy() <= 2
            yield frame.assign(mean_ms=np.where(off, 0.0, mean), variance=np.where(off | few, 0.0, variance))

    w = _per_incident()
    rows = gaps(ordinary).withColumns({"first_ms": F.first("ingested_ms").over(w), "next_ms": F.lead("ingested_ms").over(w)})
    rows = rows.select("inc", "event_id", "status", "prev_status", "place", "ingested_ms", "first_ms", "next_ms", "gap").sortWithinPartitions("inc", *ARRIVAL)
    out = rows.mapInPandas(run, "inc string, event_id long, status string, prev_status string, place int, ingested_ms long, first_ms long, next_ms double, gap double, mean_ms double, variance double")
    out = out.withColumns({"next_ms": F.col("next_ms").cast("long"), "gap": F.col("gap").cast("long")})
    deadline = C.quiet_deadline(F.col("ingested_ms"), F.col("mean_ms"), F.col("variance"), F.col("place") > 2, F.col("first_ms"))
    return out.withColumn("quiet_at_ms", F.when(F.col("status") != "resolved", deadline))


def quiet_transitions(ordinary: DataFrame) -> DataFrame:
    """Deadlines that pass before the incident's next alert arrives: ACKNOWLEDGED becomes QUIESCENT, once until it resolves.

    inc, event_id (whose deadline it was), quiet_at_ms (now cleared), idempotency_key and channel of the card that tells it.
    """
    w = _per_incident()
    # a stretch runs from an incident's start or reopening to its resolution
    opened = (F.col("status") != "resolved") & (F.col("prev_status").isNull() | (F.col("prev_status") == "resolved"))
    out = rhythm(ordinary).withColumn("stretch", F.sum(opened.cast("int")).over(w))
    due = out.filter(F.col("quiet_at_ms").isNotNull() & (F.col("next_ms").isNull() | (F.col("quiet_at_ms") < F.col("next_ms"))))
    first = due.groupBy("inc", "stretch").agg(F.min(F.struct(*ARRIVAL, "quiet_at_ms")).alias("x"))
    key = F.concat_ws(":", F.lit("quiet-deadline"), "inc", F.col("x.quiet_at_ms").cast("string"))
    return first.select("inc", "x.event_id", "x.quiet_at_ms", key.alias("idempotency_key"), F.lit("slack").alias("channel"))


def silent_resolutions(ordinary: DataFrame) -> DataFrame:
    """Silences as long as the incident's threshold at that alert: inc, event_id, silent_at_ms, threshold_ms and the key of
    the resolution, by minute. The last alert's silence has no end here and is for silence_overdue to judge."""
    w = _per_incident()
    reopened = (F.col("prev_status") == "resolved") & (F.col("status") != "resolved")
    rows = rhythm(ordinary).withColumn("reopens", F.coalesce(F.sum(reopened.cast("int")).over(w), F.lit(0)))
    rows = rows.join(ordinary.select("event_id", "severity"), "event_id").filter("status <> 'resolved' AND next_ms IS NOT NULL")
    rows = rows.withColumn("threshold_ms", C.silence_threshold(F.col("mean_ms"), F.col("variance"), F.col("severity"), F.col("reopens")))
    over = rows.filter(F.col("next_ms") - F.col("ingested_ms") >= F.col("threshold_ms")).withColumn("silent_at_ms", F.col("ingested_ms") + F.col("threshold_ms"))
    key = F.concat_ws(":", F.lit("silence"), "inc", F.floor(F.col("silent_at_ms") / 60000).cast("string"))
    return over.select("inc", "event_id", "silent_at_ms", "threshold_ms", key.alias("idempotency_key"))
