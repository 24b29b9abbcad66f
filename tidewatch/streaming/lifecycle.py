"""Incidents as keyed state in Structured Streaming, with the steps that the batch folds use, and timers.

Time is ingest time: it orders the alerts of a micro-batch and drives the watermark, which fires the timers and bounds the
windowed state. No alert is dropped for what its own clock says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import LIFECYCLE
from ..operators.folds import lifecycle_step
from ..sources.alerts import alerts_from, ordinary

_STATE = "state string, alert_count long, reopen_count long, last_flap_ms long"
_OUT = "incident_id string, state string, alert_count long, reopen_count long, cards long"
INITIAL_MS, WINDOW_MAX_MS, SPAN_MS = 5_000, 300_000, 600_000
FLOOR_MS, CEILING_MS = 900_000, 21_600_000


def _fold(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    state = dict(zip(["state", "alert_count", "reopen_count", "last_flap_ms"], group.get, strict=True)) if group.exists else None
    cards = 0
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["ingested_ms", "event_id"])
    for status, now in zip(rows["status"], rows["ingested_ms"], strict=True):
        state = lifecycle_step(state, status, int(now))
        cards += bool(state["notify"])
    group.update((state["state"], state["alert_count"], state["reopen_count"], state["last_flap_ms"]))
    yield pd.DataFrame([(key[0], state["state"], state["alert_count"], state["reopen_count"], cards)], columns=["incident_id", "state", "alert_count", "reopen_count", "cards"])


def stream_alerts(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The alert stream of a folder that events files arrive in."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return alerts_from(reader.parquet(folder))


def stream_incidents(alerts: DataFrame) -> DataFrame:
    """For each micro-batch the incidents it touched, in update mode. No alert is dropped for being late: order is arrival."""
    rows = ordinary(alerts).select("inc", "event_id", "status", "ingested_ms")
    return rows.groupBy("inc").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def stream_volume(alerts: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """Alerts in windows of 15 minutes; the watermark on ingest time only bounds the state."""
    timed = alerts.withColumn("at", F.timestamp_millis("ingested_ms")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "15 minutes"), "alertname").agg(F.count(F.lit(1)).alias("n"))


def paced(gaps: list[float]) -> tuple[float, float]:
    """Mean and variance of the gaps folded from the first one on, with alpha = 2 / (n + 1)."""
    alpha, mean, variance = 2.0 / (len(gaps) + 1), gaps[0] if gaps else 0.0, 0.0
    for gap in gaps[1:]:
        variance = (1 - alpha) * (variance + alpha * (gap - mean) ** 2)
        mean = (1 - alpha) * mean + alpha * gap
    return mean, variance


def deadlines(gaps: list[float], severity: str, reopens: int, first_ms: int, now_ms: int) -> tuple[int, int]:
    """When an incident counts as quiet, and when as over, after an alert at now_ms."""
    mean, variance = paced(gaps)
    few = len(gaps) <= 1
    spread = 0.0 if few else math.sqrt(variance)
    wait = INITIAL_MS if few else max(1, math.ceil(min(mean + spread, WINDOW_MAX_MS)))
    quiet = now_ms + wait
    if 0 < first_ms < quiet - SPAN_MS:
        quiet = max(first_ms + SPAN_MS, now_ms + 1)
    silence = max((mean + spread) * 6, FLOOR_MS) * (20.0 / 6.0 if severity == "critical" else 1.0) * 1.5 ** max(0, min(reopens, 6))
    return quiet, now_ms + int(min(silence, CEILING_MS))


class Lifecycle(StatefulProcessor):
    """One incident: its state and gaps, a timer for its quiet deadline and one for its silence.

    A later alert moves both timers; resolution clears them. A deadline that passes makes an acknowledged incident quiescent,
    a silence as long as its threshold resolves an active one. Each gives an output row with the key of its ledger entry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("incident", "state string, alert_count long, reopen_count long, last_flap_ms long, fired_ms long, first_ms long, quiet_at long, silent_at long, severity string")
        self.gaps = handle.getListState("gaps", "gap double")

    def _row(self, key: tuple, v: tuple, cause: str, at: int, entry: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], v[0], v[1], v[2], cause, at, entry)], columns=["incident_id", "state", "alert_count", "reopen_count", "cause", "at_ms", "idempotency_key"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        old = self.value.get() if self.value.exists() else None
        gaps = [g[0] for g in self.gaps.get()] if old else []
        state = dict(zip(["state", "alert_count", "reopen_count", "last_flap_ms"], old[:4], strict=True)) if old else None
        known = len(gaps)
        fired, first = (old[4], old[5]) if old else (None, None)
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ingested_ms", "event_id"])
        cards = []
        for event, status, at, now, severity in zip(frame["event_id"], frame["status"], frame["fired_ms"], frame["ingested_ms"], frame["severity"], strict=True):
            state = lifecycle_step(state, status, int(now))
            if fired is not None:
                gaps.append(float(max(0, at - fired)))
            fired, first, last, level = int(at), int(now) if first is None else first, int(now), severity
            if state["notify"]:
                cards.append((event, last))
        for timer in old[6:8] if old else ():
            if timer:
                self.handle.deleteTimer(timer)
        quiet = silent = 0
        if state["state"] != "RESOLVED":
            quiet, silent = deadlines(gaps, level, state["reopen_count"], first, last)
            self.handle.registerTimer(quiet)
            self.handle.registerTimer(silent)
        if gaps[known:]:
            self.gaps.appendList([(g,) for g in gaps[known:]])
        now_ = (state["state"], state["alert_count"], state["reopen_count"], state["last_flap_ms"], fired, first, quiet, silent, level)
        self.value.update(now_)
        for event, at in cards:
            yield self._row(key, now_, "alert", at, f"card:{event}:{key[0]}")

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        v, at = self.value.get(), expiredTimerInfo.getExpiryTimeInMs()
        if at == v[6] and (v[0], "QUIET_DEADLINE") in LIFECYCLE:
            v = (LIFECYCLE[v[0], "QUIET_DEADLINE"], *v[1:6], 0, *v[7:])
            self.value.update(v)
            yield self._row(key, v, "quiet_deadline", at, f"quiet-deadline:{key[0]}:{at}")
        elif at == v[7] and (v[0], "RESOLVE") in LIFECYCLE:
            v = (LIFECYCLE[v[0], "RESOLVE"], *v[1:6], 0, 0, v[8])
            self.value.update(v)
            yield self._row(key, v, "inferred_silence", at, f"silence:{key[0]}:{at // 60000}")

    def close(self) -> None:
        pass


def stream_transitions(alerts: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Cards, quiet deadlines and inferred resolutions as they come: incident_id, state, alert_count, reopen_count, cause, at_ms,
    idempotency_key. Needs the RocksDB state store. Within a micro-batch an incident's alerts are folded before its timers."""
    rows = ordinary(alerts).select("inc", "event_id", "status", "fired_ms", "ingested_ms", "severity", F.timestamp_millis("ingested_ms").alias("at")).withWatermark("at", lateness)
    out = "incident_id string, state string, alert_count long, reopen_count long, cause string, at_ms long, idempotency_key string"
    return rows.groupBy("inc").transformWithStateInPandas(Lifecycle(), out, "Update", "EventTime")
