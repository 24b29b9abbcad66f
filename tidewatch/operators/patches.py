"""Proposals of file changes, judged as transactions against the files of their workspaces.

A proposal's changes take effect one after the other; the first that breaks a rule ends it. What a change meets is the
workspace's files and the changes before it, and a path occurs once in a proposal: so every rule is a lookup of that path,
its ancestors or what lies below it, counted, and no proposal or workspace is replayed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import patch_path
from .store import written


@dataclass(frozen=True)
class Limits:
    changes: int = 100
    file_bytes: int = 512 * 1024
    patch_bytes: int = 1024 * 1024
    files: int = 500
    total_bytes: int = 5 * 1024 * 1024
    path: int = 240


#: Conflicts are with files that changed or are in the way; what else breaks a rule is wrong in itself.
CONFLICTS = ["exists", "missing", "hash differs", "below a file", "is a directory"]
_BY_PATCH, _BY_PATH = ["workspace", "patch_id"], ["workspace", "path"]


def _ancestors(path: str) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _above(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """rows for each directory that a path lies in, as path."""
    return rows.filter(F.contains("path", F.lit("/"))).select("workspace", *keep, F.explode(_ancestors("path")).alias("path"))


def _size(content: str) -> Column:
    return F.octet_length(content).cast("long")


def _looked_up(files: DataFrame, changes: DataFrame) -> DataFrame:
    """changes with what the workspace holds at their path, above it and below it when their turn comes."""
    known = files.select(*_BY_PATH, F.sha2("content", 256).alias("held_sha256"), _size("content").alias("held_bytes"))
    rows = changes.join(known, _BY_PATH, "left").withColumn("bytes", _size("content"))
    rows = rows.join(changes.groupBy(*_BY_PATCH, "path").agg(F.min("nr").alias("first_nr")), [*_BY_PATCH, "path"])
    effects = rows.select(*_BY_PATCH, "path", "nr", F.when(F.col("action") == "create", 1).when((F.col("action") == "delete") & F.col("held_bytes").isNotNull(), -1).alias("by")).filter("by IS NOT NULL")
    made = rows.filter("action = 'create' AND nr = first_nr").select(*_BY_PATCH, "nr", "path")
    # files above a created path: those of the workspace, and what earlier changes made or took away
    above = made.filter(F.contains("path", F.lit("/"))).select(*_BY_PATCH, "nr", F.explode(_ancestors("path")).alias("path"))
    above = above.join(known.select(*_BY_PATH, F.lit(1).alias("held")), _BY_PATH, "left")
    turns = above.join(effects.withColumnRenamed("nr", "turn"), [*_BY_PATCH, "path"], "left").filter("turn IS NULL OR turn < nr OR held IS NOT NULL")
    one = turns.groupBy(*_BY_PATCH, "nr", "path").agg((F.coalesce(F.max("held"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("turn") < F.col("nr"), F.col("by"))), F.lit(0))).alias("n"))
    blocked = one.groupBy(*_BY_PATCH, "nr").agg(F.max("n").alias("files_above"))
    # files below it: counted by directory for the workspace, and by turn for the proposal
    below = _above(files).groupBy(*_BY_PATH).agg(F.count(F.lit(1)).alias("under"))
    shifts = _above(effects, "patch_id", F.col("nr").alias("turn"), "by")
    moved = made.join(shifts, [*_BY_PATCH, "path"]).filter("turn < nr").groupBy(*_BY_PATCH, "nr").agg(F.sum("by").alias("moved"))
    rows = rows.join(below, _BY_PATH, "left").join(moved, [*_BY_PATCH, "nr"], "left").join(blocked, [*_BY_PATCH, "nr"], "left")
    return rows.withColumn("files_below", F.coalesce("under", F.lit(0)) + F.coalesce("moved", F.lit(0)))


def judged(files: DataFrame, changes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """workspace, patch_id, nr, path, verdict of every change: ok, the rule it breaks, or not reached.

    files: workspace, path, content. changes: workspace, patch_id, nr (their order, unique), path, action, expected_sha256
    (null: none), content (null: none). Other columns are left out. A null path is no path. Proposals of too many changes
    are turned down at their first change, so what is taken in order is bounded.
    """
    files = files.select("workspace", "path", F.coalesce("content", F.lit("")).alias("content"))
    changes = changes.select(*_BY_PATCH, "nr", F.coalesce("path", F.lit("")).alias("path"), "action", "expected_sha256", "content")
    rows = _looked_up(files, changes)
    held, given = F.col("held_bytes").isNotNull(), F.col("expected_sha256").isNotNull()
    differs = given & (F.lower("expected_sha256") != F.col("held_sha256"))
    content = F.when(F.col("content").isNull(), "no content").when(F.col("bytes") > limits.file_bytes, "file too large")
    fits = (F.length("path") <= limits.path) & (F.octet_length("path") <= limits.path) & patch_path(F.col("path"))
    create = F.when(held, "exists").when(given, "hash of nothing").when(F.coalesce("files_above", F.lit(0)) > 0, "below a file").when(F.col("files_below") > 0, "is a directory").otherwise(content)
    update = F.when(~held, "missing").when(differs, "hash differs").otherwise(F.coalesce(content, F.when(F.sha2("content", 256) == F.col("held_sha256"), "no change")))
    delete = F.when(~held, "missing").when(differs, "hash differs").when(F.col("content").isNotNull(), "content of a deletion")
    known = F.coalesce(F.col("action").isin("create", "update", "delete"), F.lit(False))
    verdict = F.when(~fits, "path").when(F.col("nr") > F.col("first_nr"), "path again").when(~known, "action").when(given & ~F.col("expected_sha256").rlike("^[0-9a-fA-F]{64}$"), "hash form")
    verdict = verdict.otherwise(F.when(F.col("action") == "create", create).when(F.col("action") == "update", update).otherwise(delete))
    rows = written(rows.select(*_BY_PATCH, "nr", "path", verdict.alias("broken"), F.when(F.col("action") != "delete", F.col("bytes")).alias("bytes")), "changes")
    sizes = rows.groupBy(*_BY_PATCH).agg(F.count(F.lit(1)).alias("n"), F.min("nr").alias("first"))
    rows = rows.join(sizes, _BY_PATCH)
    many = rows.filter(F.col("n") > limits.changes).withColumn("broken", F.lit("too many changes"))
    few = rows.filter(F.col("n") <= limits.changes).withColumn("sum", F.sum("bytes").over(Window.partitionBy(*_BY_PATCH).orderBy("nr")))
    few = few.withColumn("broken", F.coalesce("broken", F.when(F.col("sum") > limits.patch_bytes, "patch too large"))).drop("sum")
    rows = few.unionByName(many)
    ends = rows.filter("broken IS NOT NULL").groupBy(*_BY_PATCH).agg(F.min("nr").alias("end"))
    rows = rows.join(ends, _BY_PATCH, "left")
    return rows.select(*_BY_PATCH, "nr", "path", F.when(F.col("nr") > F.col("end"), "not reached").otherwise(F.coalesce("broken", F.lit("ok"))).alias("verdict"))


def proposals(files: DataFrame, changes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """workspace, patch_id, verdict, kind (ok, conflict or invalid), nr (of the change that ended it), files and bytes that
    the workspace would then hold. Where all changes hold, the resulting files must: their number, size and sum."""
    verdicts = written(judged(files, changes, limits), "verdicts")
    ended = verdicts.groupBy(*_BY_PATCH).agg(F.min(F.when(~F.col("verdict").isin("ok", "not reached"), F.struct("nr", "verdict"))).alias("x"))
    sized = files.select("workspace", "path", F.coalesce(_size("content"), F.lit(0)).alias("b"))
    totals = sized.groupBy("workspace").agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"), F.count_if(F.col("b") > limits.file_bytes).alias("large"))
    delta = verdicts.filter("verdict = 'ok'").join(changes.select(*_BY_PATCH, "nr", "content"), [*_BY_PATCH, "nr"]).join(sized, _BY_PATH, "left")
    after, before = F.coalesce(_size("content"), F.lit(0)), F.coalesce("b", F.lit(0))
    moved = delta.groupBy(*_BY_PATCH).agg(
        F.sum(F.col("content").isNotNull().cast("long") - F.col("b").isNotNull().cast("long")).alias("more"),
        F.sum(after - before).alias("grown"),
        F.count_if(before > limits.file_bytes).alias("mended"),
    )
    rows = ended.join(totals, "workspace", "left").join(moved, _BY_PATCH, "left")
    count = F.coalesce("files", F.lit(0)) + F.coalesce("more", F.lit(0))
    total = F.coalesce("bytes", F.lit(0)) + F.coalesce("grown", F.lit(0))
    whole = F.when(count > limits.files, "too many files").when(F.coalesce("large", F.lit(0)) > F.coalesce("mended", F.lit(0)), "file too large").when(total > limits.total_bytes, "files too large")
    verdict = F.coalesce("x.verdict", whole, F.lit("ok"))
    good = verdict == "ok"
    kind = F.when(good, "ok").when(verdict.isin(CONFLICTS), "conflict").otherwise("invalid")
    return rows.select(*_BY_PATCH, verdict.alias("verdict"), kind.alias("kind"), F.col("x.nr").alias("nr"), F.when(good, count).alias("files"), F.when(good, total).alias("bytes"))
