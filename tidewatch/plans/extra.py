"""Iterative and history-dependent queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tree
from .duck import OUTBOX
from .registry import add


def reconcile(outbox: DataFrame) -> DataFrame:
    """Callbacks applied to incidents: a known id is a duplicate, an unknown kind or an edge that does not exist is ignored."""
    k = F.col("k")
    actions = outbox.filter("external_ref IS NOT NULL").select("outbox_id", "incident_id", F.concat_ws("/", "channel", "external_ref").alias("inbound_id"), F.when(k % 4 == 0, "resolve").when(k % 4 == 1, "acknowledge").otherwise("note").alias("kind"))
    once = actions.withColumn("copy", F.row_number().over(Window.partitionBy("inbound_id").orderBy("outbox_id")))
    # an incident starts acknowledged: only its first resolve changes anything
    order = F.sum(((F.col("copy") == 1) & (F.col("kind") == "resolve")).cast("int")).over(Window.partitionBy("incident_id").orderBy("outbox_id"))
    return once.withColumn("nth", order).select("outbox_id", F.when(F.col("copy") > 1, "duplicate").when((F.col("kind") == "resolve") & (F.col("nth") == 1), "applied").otherwise("ignored").alias("status"))


add("reconcile_actions", lambda f: reconcile(f.outbox()), """SELECT outbox_id, CASE WHEN copy>1 THEN 'duplicate' WHEN kind='resolve' AND nth=1 THEN 'applied' ELSE 'ignored' END AS status FROM (
    SELECT *, sum(CASE WHEN copy=1 AND kind='resolve' THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id ORDER BY outbox_id) AS nth FROM (
    SELECT outbox_id, incident_id, CASE WHEN k%4=0 THEN 'resolve' WHEN k%4=1 THEN 'acknowledge' ELSE 'note' END AS kind, row_number() OVER (PARTITION BY channel||'/'||external_ref ORDER BY outbox_id) AS copy FROM outbox WHERE external_ref IS NOT NULL))""", OUTBOX)  # fmt: skip


def _tree(f) -> DataFrame:
    """Parts as a tree of eight branches; some are their own ancestors, some hang below a part that does not exist."""
    key = F.col("p_partkey")
    parent = F.when(key % 97 == 13, key).when(key % 89 == 17, -key).when(key >= 8, F.expr("p_partkey div 8"))
    return f.table("part").select(key.alias("id"), parent.alias("parent"), F.concat(F.lit("n"), key.cast("string")).alias("name"))


add("tree_walk", lambda f: tree.walk(_tree(f)).drop("steps"),
    """WITH RECURSIVE e AS (SELECT p_partkey AS id, CASE WHEN p_partkey%97=13 THEN p_partkey WHEN p_partkey%89=17 THEN -p_partkey WHEN p_partkey>=8 THEN p_partkey//8 END AS parent, 'n'||p_partkey AS name FROM part),
    w(id, path, depth) AS (SELECT id, name, 0 FROM e WHERE parent IS NULL UNION ALL SELECT e.id, w.path||'/'||e.name, w.depth+1 FROM w JOIN e ON e.parent=w.id),
    up(id, hi) AS (SELECT id, parent FROM e WHERE parent IS NOT NULL UNION SELECT up.id, e.parent FROM up JOIN e ON e.id=up.hi WHERE e.parent IS NOT NULL),
    lost AS (SELECT DISTINCT id FROM up WHERE hi NOT IN (SELECT id FROM e))
    SELECT e.id, w.path, w.depth, CASE WHEN w.id IS NOT NULL THEN 'ok' WHEN lost.id IS NOT NULL THEN 'no parent' ELSE 'cycle' END AS verdict FROM e LEFT JOIN w USING (id) LEFT JOIN lost USING (id)""")  # fmt: skip


def causal_layers(edges: DataFrame) -> DataFrame:
    """scope_key, node, layer: the longest way to each node over a snapshot's dominant edges; an edge that closes a cycle counts 0."""

    def layers(frame: pd.DataFrame) -> pd.DataFrame:
        above: dict[str, list[str]] = {}
        for src, dst in zip(frame.src, frame.dst, strict=True):
            above.setdefault(dst, []).append(src)
            above.setdefault(src, [])
        found: dict[str, int] = {}
        for start in sorted(above):
            stack, open_ = [(start, iter(sorted(above[start])))], {start}
            while stack:
                node, rest = stack[-1]
                for up in rest:
                    if up not in found and up not in open_:
                        open_.add(up)
                        stack.append((up, iter(sorted(above[up]))))
                        break
                else:
                    found.setdefault(node, max((found.get(u, -1) + 1 for u in above[node]), default=0))
                    open_.discard(node)
                    stack.pop()
        return pd.DataFrame([(frame.scope_key.iloc[0], n, d) for n, d in found.items()], columns=["scope_key", "node", "layer"])

    recent = edges.withColumn("rk", F.row_number().over(Window.partitionBy("scope_key").orderBy(F.desc("last_seen_ms"), "src", "dst"))).filter("rk <= 200")
    rank = F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.round("weight", 6).desc(), "src"))
    dominant = recent.withColumn("d", rank).filter("d = 1").select("scope_key", "src", "dst")
    return dominant.groupBy("scope_key").applyInPandas(layers, "scope_key string, node string, layer long")


add("causal_layers", lambda f: causal_layers(f.edges()))


def patch_plan(changes: DataFrame, max_bytes: int = 65536) -> DataFrame:
    """changes: path, before, after (null: create, or delete). With the operation, whether it is allowed, hashes and a unified diff."""

    @F.pandas_udf("string")
    def diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        import difflib

        lines = lambda s: (s or "").splitlines(keepends=True)
        return pd.Series(["".join(difflib.unified_diff(lines(b), lines(a), f"a/{p}", f"b/{p}")) for p, b, a in zip(path, before, after, strict=True)])

    operation = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
    fits = F.coalesce(F.octet_length("after"), F.lit(0)) <= max_bytes
    only = F.count(F.lit(1)).over(Window.partitionBy("path")) == 1
    plan = changes.withColumns({"operation": operation, "allowed": fits & only & ~F.col("before").eqNullSafe(F.col("after"))}).filter("allowed")
    return plan.select("path", "operation", F.sha2("before", 256).alias("before_sha256"), F.sha2("after", 256).alias("after_sha256"), diff("path", "before", "after").alias("diff"))


def _changes(f) -> DataFrame:
    d = F.col("doc_id")
    return f.table("documents").select(F.concat(F.col("source"), F.lit("/"), d.cast("string")).alias("path"), F.when(d % 5 != 0, F.col("text")).alias("before"), F.when(d % 7 != 0, F.concat("text", F.lit("\nreviewed\n"))).alias("after")).filter("before IS NOT NULL OR after IS NOT NULL")


add("patch_plan", lambda f: patch_plan(_changes(f)))
