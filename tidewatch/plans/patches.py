"""Proposals over workspaces of documents: most hold, each rule is broken by some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import patches
from .registry import Frames, query
from .repository import _PATCH


def workspaces(f: Frames) -> DataFrame:
    """Four documents of five are files; 200 ids make a workspace."""
    d = F.col("doc_id")
    rows = f.table("documents").select(F.expr("doc_id div 200").alias("workspace"), d.alias("d"), F.concat(F.lit("d"), (d % 7).cast("string"), F.lit("/f"), d.cast("string")).alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    return rows


def files(f: Frames) -> DataFrame:
    return workspaces(f).filter("d % 5 <> 0").select("workspace", F.col("own").alias("path"), F.col("text").alias("content"))


def changes(f: Frames) -> DataFrame:
    """A change for each document; five ids make a proposal."""
    rows = workspaces(f).withColumns({"r": F.expr("d * 7919 % 97"), "sha": F.sha2("text", 256), "t": F.col("d").cast("string")})
    rows = rows.withColumn("kind", F.expr("CASE WHEN r < 16 THEN r WHEN d % 5 = 0 OR r % 3 = 0 THEN 0 WHEN r % 3 = 1 THEN 1 ELSE 3 END"))
    path = "CASE WHEN kind IN (0, 15) THEN concat('new/n', t) WHEN kind = 6 THEN concat('gone/x', t) WHEN kind = 7 THEN concat(own, '/child') WHEN kind = 8 THEN concat('d', d % 7) WHEN kind = 11 THEN concat('new/n', d - 1) WHEN kind = 12 THEN concat('../x', t) ELSE own END"
    return rows.select(
        "workspace",
        F.expr("d div 5").alias("patch_id"),
        (F.col("d") % 5).alias("nr"),
        F.expr(path).alias("path"),
        F.expr("CASE WHEN kind IN (0, 5, 7, 8, 11, 15) THEN 'create' WHEN kind IN (3, 4) THEN 'delete' WHEN kind = 13 THEN 'rename' ELSE 'update' END").alias("action"),
        F.expr("CASE WHEN kind IN (1, 3, 15) THEN sha WHEN kind = 2 THEN sha2(t, 256) WHEN kind = 14 THEN 'f00' END").alias("expected_sha256"),
        F.expr("CASE WHEN kind IN (3, 10) THEN NULL WHEN kind = 9 THEN text ELSE concat(text, ' reviewed') END").alias("content"),
    )


_CTES = rf"""w AS (SELECT doc_id//200 AS workspace, doc_id AS d, 'd'||(doc_id%7)||'/f'||doc_id AS own, coalesce(text,'') AS text FROM documents),
files AS (SELECT workspace, own AS fpath, text AS old FROM w WHERE d%5<>0),
k AS (SELECT *, CASE WHEN d*7919%97<16 THEN d*7919%97 WHEN d%5=0 OR d*7919%97%3=0 THEN 0 WHEN d*7919%97%3=1 THEN 1 ELSE 3 END AS kind FROM w),
ch AS (SELECT workspace, d//5 AS patch_id, d%5 AS nr, CASE WHEN kind IN (0,15) THEN 'new/n'||d WHEN kind=6 THEN 'gone/x'||d WHEN kind=7 THEN own||'/child' WHEN kind=8 THEN 'd'||(d%7) WHEN kind=11 THEN 'new/n'||(d-1) WHEN kind=12 THEN '../x'||d ELSE own END AS path,
  CASE WHEN kind IN (0,5,7,8,11,15) THEN 'create' WHEN kind IN (3,4) THEN 'delete' WHEN kind=13 THEN 'rename' ELSE 'update' END AS act,
  CASE WHEN kind IN (1,3,15) THEN sha256(text) WHEN kind=2 THEN sha256(CAST(d AS VARCHAR)) WHEN kind=14 THEN 'f00' END AS want, CASE WHEN kind IN (3,10) THEN NULL WHEN kind=9 THEN text ELSE text||' reviewed' END AS content FROM k),
c AS (SELECT ch.*, f.old, sum(CASE WHEN act<>'delete' THEN strlen(content) END) OVER (PARTITION BY patch_id ORDER BY nr) AS spent,
  EXISTS (SELECT 1 FROM ch e WHERE e.patch_id=ch.patch_id AND e.path=ch.path AND e.nr<ch.nr) AS again FROM ch LEFT JOIN files f ON f.workspace=ch.workspace AND f.fpath=ch.path),
v AS (SELECT c.*, CASE WHEN NOT ({_PATCH}) OR length(path)>240 OR strlen(path)>240 THEN 'path' WHEN again THEN 'path again' WHEN act NOT IN ('create','update','delete') THEN 'action' WHEN NOT regexp_full_match(want, '[0-9a-fA-F]{{64}}') THEN 'hash form'
  WHEN act='create' THEN CASE WHEN old IS NOT NULL THEN 'exists' WHEN want IS NOT NULL THEN 'hash of nothing'
    WHEN EXISTS (SELECT 1 FROM files x WHERE x.workspace=c.workspace AND starts_with(c.path, x.fpath||'/') AND NOT EXISTS (SELECT 1 FROM ch e WHERE e.patch_id=c.patch_id AND e.path=x.fpath AND e.act='delete' AND e.nr<c.nr)) OR EXISTS (SELECT 1 FROM ch e WHERE e.patch_id=c.patch_id AND e.act='create' AND e.nr<c.nr AND starts_with(c.path, e.path||'/')) THEN 'below a file'
    WHEN EXISTS (SELECT 1 FROM files x WHERE x.workspace=c.workspace AND starts_with(x.fpath, c.path||'/') AND NOT EXISTS (SELECT 1 FROM ch e WHERE e.patch_id=c.patch_id AND e.path=x.fpath AND e.act='delete' AND e.nr<c.nr)) OR EXISTS (SELECT 1 FROM ch e WHERE e.patch_id=c.patch_id AND e.act='create' AND e.nr<c.nr AND starts_with(e.path, c.path||'/')) THEN 'is a directory'
    WHEN content IS NULL THEN 'no content' WHEN strlen(content)>524288 THEN 'file too large' END
  WHEN old IS NULL THEN 'missing' WHEN lower(want)<>sha256(old) THEN 'hash differs'
  WHEN act='update' THEN CASE WHEN content IS NULL THEN 'no content' WHEN strlen(content)>524288 THEN 'file too large' WHEN content=old THEN 'no change' END
  WHEN content IS NOT NULL THEN 'content of a deletion' END AS rule FROM c),
b AS (SELECT *, coalesce(rule, CASE WHEN spent>1048576 THEN 'patch too large' END) AS broken FROM v),
j AS (SELECT *, CASE WHEN nr>min(CASE WHEN broken IS NOT NULL THEN nr END) OVER (PARTITION BY patch_id) THEN 'not reached' ELSE coalesce(broken,'ok') END AS verdict FROM b)"""


@query("patch_verdicts", "SELECT patch_id, nr, path, verdict FROM j", _CTES)
def patch_verdicts(f: Frames) -> DataFrame:
    return patches.judged(files(f), changes(f)).select("patch_id", "nr", "path", "verdict")


@query(
    "patch_proposals",
    """SELECT patch_id, verdict, kind, nr, CASE WHEN kind='ok' THEN files END AS files, CASE WHEN kind='ok' THEN bytes END AS bytes FROM (SELECT *, CASE WHEN verdict='ok' THEN 'ok' WHEN verdict IN ('exists','missing','hash differs','below a file','is a directory') THEN 'conflict' ELSE 'invalid' END AS kind FROM (
    SELECT patch_id, nr, files, bytes, CASE WHEN broken IS NOT NULL THEN broken WHEN files>500 THEN 'too many files' WHEN large>0 THEN 'file too large' WHEN bytes>5242880 THEN 'files too large' ELSE 'ok' END AS verdict FROM (
    SELECT patch_id, min(CASE WHEN verdict NOT IN ('ok','not reached') THEN nr END) AS nr, min(CASE WHEN verdict NOT IN ('ok','not reached') THEN verdict END) AS broken,
      any_value(t.n)+sum(CASE act WHEN 'create' THEN 1 WHEN 'delete' THEN -1 ELSE 0 END) AS files, any_value(t.b)+sum(coalesce(strlen(content),0)-coalesce(strlen(old),0)) AS bytes, any_value(t.large)-count_if(strlen(old)>524288) AS large
    FROM j LEFT JOIN (SELECT workspace, count(*) AS n, sum(strlen(old)) AS b, count_if(strlen(old)>524288) AS large FROM files GROUP BY workspace) t USING (workspace) GROUP BY patch_id)))""",
    _CTES,
)
def patch_proposals(f: Frames) -> DataFrame:
    return patches.proposals(files(f), changes(f)).drop("workspace")
