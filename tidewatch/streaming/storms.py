"""Storms as keyed state: each scope's incidents, edges and groups in map states, alert by alert in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.storms import Replay
from ..sources.alerts import ordinary

_OUT = "scope_key string, group_id string, formed_ms long, formed_event long, members long, active long, root string, gone boolean"


class Storms(StatefulProcessor):
    """One scope. After each micro-batch a row for every group that it touched; gone tells that an older one has taken it over.

    A state entry is written only where an alert changed it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.incidents = handle.getMapState("incidents", "name string", "status string, at long, event long, fired long, first long, severity string, grp string")
        self.edges = handle.getMapState("edges", "src string, dst string", "weight double, seen long")
        self.groups = handle.getMapState("groups", "name string", "at long, event long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        replay = Replay().restore({k[0]: tuple(v) for k, v in self.incidents.iterator()}, {tuple(k): tuple(v) for k, v in self.edges.iterator()}, {k[0]: tuple(v) for k, v in self.groups.iterator()})
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ingested_ms", "event_id"])
        touched = set()
        for inc, event, status, severity, at, fired in frame[["inc", "event_id", "status", "severity", "ingested_ms", "fired_ms"]].itertuples(index=False, name=None):
            touched.add(replay.step(inc, int(event), status, severity, int(at), int(fired)))
        for kind, name in replay.changed:
            if kind == "incident":
                self.incidents.updateValue((name,), replay.incidents[name])
            elif kind == "edge":
                self.edges.updateValue(name, replay.edges[name])
            elif name in replay.groups:
                self.groups.updateValue((name,), replay.groups[name])
            elif self.groups.containsKey((name,)):
                self.groups.removeKey((name,))
        dropped = {name for kind, name in replay.changed if kind == "group"} - set(replay.groups)
        found = [(key[0], *replay.facts(name), False) for name in sorted(touched - {None} - dropped)] + [(key[0], name, 0, 0, 0, 0, "", True) for name in sorted(dropped)]
        yield pd.DataFrame(found, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_storms(alerts: DataFrame) -> DataFrame:
    """scope_key, group_id (the anchor), formed_ms, formed_event, members, active, root, gone. Needs the RocksDB state store."""
    rows = ordinary(alerts).select("scope_key", "inc", "event_id", "status", "severity", "ingested_ms", "fired_ms")
    return rows.groupBy("scope_key").transformWithStateInPandas(Storms(), _OUT, "Update", "None")
