"""Callbacks as they arrive: delivery ids that expire, then each incident's state and who first changed it.

Alerts and callbacks are two streams. A delivery id is a state of its own, wherever the callback belongs, and is forgotten
after a time to live, from when on the same id counts as new. What is left is merged with the alerts by incident. Within a
micro-batch all are taken in the order of their times (alerts first, then callbacks by id), as in operators/callbacks.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..operators.callbacks import TRIGGERS
from ..sources.alerts import ordinary

DAY_MS = 86_400_000
_TOLD = "callback_id long, inbound_id string, incident_id string, provider string, kind string, actor string, source string, detail string, at_ms long"
_MARKED = _TOLD + ", copy boolean"
_FIRST = "acknowledged_ms long, acknowledged_by string, acknowledged_via string, resolved_ms long, resolved_via string, resolution_source string, resolution_detail string"
_OUT = "callback_id long, incident_id string, verdict string, reason string, status string, " + _FIRST


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _values(frame: pd.DataFrame) -> Iterator[tuple]:
    """Rows with None for what is missing."""
    return frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)


class Deliveries(StatefulProcessor):
    """One delivery id: its first callback passes, the others are marked as copies until the id has expired."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "callback_id long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "callback_id"]).reset_index(drop=True)
        known = self.first.exists()
        if not known:
            self.first.update((int(frame.callback_id[0]),))
        yield frame[_names(_TOLD)].assign(copy=(frame.index > 0) | known)

    def close(self) -> None:
        pass


class Reconciled(StatefulProcessor):
    """One incident: its status, and the first that said when, who and how it was acknowledged and resolved."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, " + _FIRST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        names = _names(_FIRST)
        held = tuple(self.state.get()) if self.state.exists() else None
        status, first = (held[0], dict(zip(names, held[1:], strict=True))) if held else (None, dict.fromkeys(names))
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "turn", "callback_id"])
        out = []
        for at, turn, callback, kind, leaves, copy, provider, actor, source, detail in _values(frame[["at_ms", "turn", "callback_id", "kind", "leaves", "copy", "provider", "actor", "source", "detail"]]):
            if turn == 0:
                status = leaves
                continue
            after = C.LIFECYCLE.get((status, TRIGGERS.get(kind)))
            if copy:
                verdict, reason = "duplicate", "replayed"
            elif kind not in TRIGGERS:
                verdict, reason = "ignored", f"unknown kind: {kind or ''}"
            elif status is None:
                verdict, reason = "ignored", "unknown incident"
            elif after is None:
                verdict, reason = "ignored", f"no transition from {status}"
            else:
                verdict, reason, status = "applied", f"{status} -> {after}", after
                said = {"acknowledged_ms": at, "acknowledged_by": actor, "acknowledged_via": provider} if kind == "acknowledge" else {"resolved_ms": at, "resolved_via": provider, "resolution_source": source, "resolution_detail": detail}
                first |= {name: value for name, value in said.items() if first[name] is None}
            out.append((callback, key[0], verdict, reason, status, *first.values()))
        if status is not None:
            now = (status, *(int(v) if isinstance(v, float) else v for v in first.values()))
            if now != held:
                self.state.update(now)
        yield pd.DataFrame(out, columns=_names(_OUT)).astype({n: "Int64" for n in ("callback_id", "acknowledged_ms", "resolved_ms")})

    def close(self) -> None:
        pass


def stream_reconciled(alerts: DataFrame, callbacks: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """For each callback what became of it and what its incident's state and provenance are then. Needs the RocksDB state store.

    Callbacks that fall between two alerts have to arrive between them, in order of time; those without an incident's alert
    before them are of an unknown incident, and leave no state.
    """
    told = callbacks.select(*_names(_TOLD)).groupBy("inbound_id").transformWithStateInPandas(Deliveries(ttl_ms), _MARKED, "Append", "ProcessingTime")
    leaves = F.when(F.col("status") == "resolved", "RESOLVED").otherwise("ACKNOWLEDGED")
    arrived = ordinary(alerts).select(F.col("inc").alias("incident_id"), F.col("ingested_ms").alias("at_ms"), F.lit(0).alias("turn"), F.col("event_id").alias("callback_id"), leaves.alias("leaves"))
    merged = arrived.unionByName(told.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return merged.groupBy("incident_id").transformWithStateInPandas(Reconciled(), _OUT, "Append", "None")
