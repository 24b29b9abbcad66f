"""All queries of the alert-stream operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import callbacks, core, dashboard, delivery, extra, graphs, ingest, patches, queue, repository, storms  # noqa: F401  registers the queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
