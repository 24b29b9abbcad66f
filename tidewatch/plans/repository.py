"""Repository inventory and source-context queries: documents stand for files, suppliers for repositories, nations for
installations, parts for snapshots. One function per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .duck import ALERTS, INCIDENTS
from .registry import Frames, query

#: Bounds of a source context: bytes of a file and of all, and files.
FILE_BYTES, TOTAL_BYTES, FILES = 64 * 1024, 256 * 1024, 12
_DIRS = "['/', '/node_modules/', '/../', '/src/', '/.ssh/', '/Build/', '/a\\b/', '/con/', '/aux.d/', '/x:y/', '/trail./', '/deep_er/path-to/', '/secrets/']"
_NAMES = "['.py', '.min.js', '.exe', '.ts', '.md', '.tsx', '.YML', '.env', '.go', '']"
#: The path of a document, in SQL that both engines read; {d} and {n} take an element of a list.
_PATH = "source || {d} || 'f' || doc_id || {n}"
_DOCUMENTS = f"SELECT doc_id, source, text, n_chars, strlen(text) AS size, {_PATH.format(d=f'{_DIRS}[CAST(doc_id%13 AS INT)+1]', n=f'{_NAMES}[CAST(doc_id%10 AS INT)+1]')} AS path FROM documents"
_FILES = f"files AS ({_DOCUMENTS} WHERE text IS NOT NULL)"
_PARTS = r"string_split(lower(path), '/')"
_SAFE = rf"""(length(path)<=512 AND NOT contains(path, chr(92)) AND NOT list_bool_or(list_transform({_PARTS}, lambda p: p IN ('','.','..')))
  AND NOT coalesce(list_bool_or(list_transform({_PARTS}[:-2], lambda p: p IN ('.next','build','coverage','dist','node_modules','vendor'))), false)
  AND NOT list_bool_or(list_transform({_PARTS}, lambda p: p IN ('.aws','.ssh','credentials','secrets'))) AND NOT regexp_matches({_PARTS}[-1], '^(id_ed25519|id_rsa|\.env|\.env\..*)$')
  AND NOT regexp_matches({_PARTS}[-1], '\.(map|min\.css|min\.js|lock)$')
  AND regexp_matches({_PARTS}[-1], '\.(c|cc|cpp|cs|css|go|h|hpp|html|java|js|json|jsx|kt|md|php|py|rb|rs|sh|sql|toml|ts|tsx|txt|yaml|yml)$'))"""


def paths(f: Frames) -> DataFrame:
    """doc_id, source, path, size (bytes), text of all documents, with or without a text; paths of every awkward kind."""
    array = lambda names: F.array(*(F.lit(n.strip().strip("'")) for n in names.strip("[]").split("', ")))
    take = lambda names, m: F.element_at(array(names), (F.col("doc_id") % m + 1).cast("int"))
    path = F.concat("source", take(_DIRS, 13), F.lit("f"), F.col("doc_id").cast("string"), take(_NAMES, 10))
    return f.table("documents").select("doc_id", "source", path.alias("path"), F.octet_length("text").alias("size"), "text", "n_chars")


def files(f: Frames) -> DataFrame:
    """The documents that have a text, as files."""
    return paths(f).filter("text IS NOT NULL")


@query("safe_paths", f"WITH {_FILES} SELECT doc_id, path FROM files WHERE {_SAFE}")
def safe_paths(f: Frames) -> DataFrame:
    return files(f).filter(T.safe_path(F.col("path"))).select("doc_id", "path")


_PATCH = r"""length(path)<=512 AND strlen(path)<=512 AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '[\x00-\x1f]') AND NOT list_bool_or(list_transform(string_split(path, '/'), lambda p: p IN ('','.','..'))) AND NOT list_bool_or(list_transform(string_split(path, '/'), lambda p: contains(p, ':') OR ends_with(p, '.') OR ends_with(p, ' ') OR regexp_matches(string_split(p, '.')[1], '^(?i:con|prn|aux|nul|clock\$|com[1-9]|lpt[1-9])$')))"""


@query("patch_paths", f"WITH files AS ({_DOCUMENTS}) SELECT doc_id, path, {_SAFE} AS readable FROM files WHERE {_PATCH}")
def patch_paths(f: Frames) -> DataFrame:
    """The paths that may be written, and whether each may be read too. A path is judged before what it holds, and a deletion
    has no content: so documents without a text count."""
    return paths(f).filter(T.patch_path(F.col("path"))).select("doc_id", "path", T.safe_path(F.col("path")).alias("readable"))


_LANG = "{" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"


@query("language_hint", f"WITH {_FILES} SELECT doc_id, element_at(MAP {_LANG}, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)))[1] AS language FROM files")
def language_hint(f: Frames) -> DataFrame:
    return files(f).select("doc_id", T.language(F.col("path")).alias("language"))


def _token_sql(value: str) -> str:
    words = f"list_transform(regexp_extract_all({value}, '[A-Za-z0-9][A-Za-z0-9_-]{{1,63}}'), lambda x: lower(x))"
    return f"list_distinct({words} || list_filter(flatten(list_transform({words}, lambda w: regexp_split_to_array(w, '[_-]+'))), lambda p: length(p)>=2))"


@query("signal_tokens", f"WITH {_FILES} SELECT doc_id, array_to_string(list_sort({_token_sql('path')}), ',') AS tokens, len({_token_sql('text')}) AS n_tokens FROM files")
def signal_tokens(f: Frames) -> DataFrame:
    """The tokens of each path, and how many distinct ones its whole text has."""
    return files(f).select("doc_id", F.array_join(F.array_sort(T.tokens(F.col("path"))), ",").alias("tokens"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


#: What an incident says, for the ranking of files.
SIGNALS = ["src3", "deep_er path", "ts"]
_HITS = f"len(list_intersect({_token_sql('path')}, ['src3','deep_er','deep','er','path','ts']))"
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_HITS} DESC, size, path) AS rk FROM files WHERE {_SAFE} AND size<={FILE_BYTES})"


def selected(rows: DataFrame, signals: list[str], file_bytes: int = FILE_BYTES, most: int = FILES) -> DataFrame:
    """The best files of each source: safe, not too large, one for each path; by shared tokens, then size, then path."""
    said = F.array_distinct(F.flatten(F.array(*(T.tokens(F.lit(s)) for s in signals))))
    fit = rows.filter(T.safe_path(F.col("path")) & (F.coalesce("size", F.lit(0)) <= file_bytes)).dropDuplicates(["source", "path"])
    hits = F.size(F.array_intersect(T.tokens(F.col("path")), said))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("hits"), F.coalesce("size", F.lit(file_bytes)), "path"))
    return fit.withColumn("hits", hits).withColumn("rk", rank).filter(F.col("rk") <= most)


@query("source_rank", f"WITH {_FILES}, {_RANKED} SELECT source, doc_id, rk FROM ranked WHERE rk<={FILES}")
def source_rank(f: Frames) -> DataFrame:
    return selected(files(f), SIGNALS).select("source", "doc_id", F.col("rk").cast("long").alias("rk"))


def source_context(f: Frames, total: int = TOTAL_BYTES) -> DataFrame:
    """source, files (structs of rk, path, blob, size, doc_id) that fit, used, omitted: taken in order of rank; one that would
    be too much is skipped, not the end. Binary files are left out. At most FILES rows of a source are ever collected."""
    rows = selected(files(f), SIGNALS).withColumns({"blob": F.sha1(F.col("text").cast("binary")), "binary": F.contains("text", F.lit("\0"))})
    each = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rk", "path", "blob", "size", "doc_id", "binary"))).alias("all"))
    kind = "struct<rk:int,path:string,blob:string,size:int,doc_id:bigint,binary:boolean>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("taken"))
    fits = lambda s, x: ~x["binary"] & (s["used"] + x["size"] <= total)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["size"]).alias("used"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s)
    folded = each.select("source", F.size("all").alias("n"), F.aggregate("all", start, step).alias("r"))
    return folded.select("source", F.col("r.taken").alias("files"), F.col("r.used").alias("used"), (F.col("n") - F.size("r.taken")).cast("long").alias("omitted"))


_TAKE = _FILES.replace("files AS", "RECURSIVE files AS", 1) + f""", {_RANKED},
take(source, rk, used, ok) AS (SELECT DISTINCT source, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM ranked UNION ALL
  SELECT r.source, r.rk, t.used+CASE WHEN t.used+r.size<={TOTAL_BYTES} AND NOT contains(r.text, chr(0)) THEN r.size ELSE 0 END, t.used+r.size<={TOTAL_BYTES} AND NOT contains(r.text, chr(0)) FROM take t JOIN ranked r ON r.source IS NOT DISTINCT FROM t.source AND r.rk=t.rk+1 WHERE r.rk<={FILES}),
ctx AS (SELECT r.*, ok, t.used FROM take t JOIN ranked r ON r.source IS NOT DISTINCT FROM t.source AND r.rk=t.rk)"""  # fmt: skip


@query("source_context", f"WITH {_TAKE} SELECT source, max(used) AS used, count(*) FILTER (WHERE ok) AS files, count(*) FILTER (WHERE NOT ok) AS omitted FROM ctx GROUP BY source")
def source_budget(f: Frames) -> DataFrame:
    return source_context(f).select("source", "used", F.size("files").cast("long").alias("files"), "omitted")


@query("context_digest", f"WITH {_TAKE} SELECT source, sha256(coalesce(string_agg(path||chr(0)||sha1(text)||chr(0)||size, chr(10) ORDER BY rk) FILTER (WHERE ok), '')) AS digest FROM ctx GROUP BY source")
def context_digest(f: Frames) -> DataFrame:
    """A source context's identity: path, blob and bytes of each file that is in it, in order."""
    line = lambda x: F.concat(x["path"], F.lit("\0"), x["blob"], F.lit("\0"), x["size"].cast("string"))
    return source_context(f).select("source", F.sha2(F.array_join(F.transform("files", line), "\n"), 256).alias("digest"))


@query("excerpt_rows", f"WITH {_TAKE} SELECT source, path, 1 AS start_line, length(text)-length(replace(text, chr(10), ''))+1 AS end_line, element_at(MAP {_LANG}, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)))[1] AS language FROM ctx WHERE ok AND regexp_matches(text, '[^ \\t\\n\\r]')")
def excerpt_rows(f: Frames) -> DataFrame:
    """The excerpts of a diagnosis request: the context's files that are not blank, with their lines and language."""
    taken = source_context(f).select(F.explode("files").alias("x")).select("x.doc_id")
    rows = files(f).join(taken, "doc_id").filter(F.col("text").rlike(r"[^ \t\n\r]"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select("source", "path", F.lit(1).alias("start_line"), lines.cast("long").alias("end_line"), T.language(F.col("path")).alias("language"))


def grounded(evidence: DataFrame, excerpts: DataFrame) -> DataFrame:
    """evidence (source, path, start_line, end_line, fix_path) with whether it holds: a range of lines within a supplied
    excerpt of that path, and a fix of a path that was supplied."""
    known = excerpts.select("source", "path", F.col("end_line").alias("last"))
    fixes = excerpts.select("source", F.col("path").alias("fix_path"), F.lit(True).alias("fix_known"))
    joined = evidence.join(known, ["source", "path"], "left").join(fixes, ["source", "fix_path"], "left")
    inside = F.col("last").isNotNull() & (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("last"))
    return joined.withColumn("ok", inside & F.coalesce("fix_known", F.lit(False)))


@query(
    "evidence_grounding",
    f"""WITH {_TAKE}, ex AS (SELECT source, path, length(text)-length(replace(text, chr(10), ''))+1 AS last FROM ctx WHERE ok AND regexp_matches(text, '[^ \\t\\n\\r]')),
    claim AS (SELECT doc_id, source, path, CAST(doc_id%3 AS BIGINT) AS a, CAST(doc_id%17 AS BIGINT) AS b, CASE WHEN doc_id%4=0 THEN 'elsewhere.py' ELSE path END AS fix FROM files)
    SELECT doc_id, coalesce(c.a>=1 AND c.a<=c.b AND c.b<=e.last, false) AND EXISTS (SELECT 1 FROM ex g WHERE g.source=c.source AND g.path=c.fix) AS ok FROM claim c LEFT JOIN ex e ON e.source=c.source AND e.path=c.path""",
)
def evidence_grounding(f: Frames) -> DataFrame:
    """A claim about every file, most of them about files or lines that were not supplied."""
    d = F.col("doc_id")
    claims = files(f).select("doc_id", "source", "path", (d % 3).alias("start_line"), (d % 17).alias("end_line"), F.when(d % 4 == 0, "elsewhere.py").otherwise(F.col("path")).alias("fix_path"))
    return grounded(claims, f.kept("excerpts", lambda: excerpt_rows(f))).select("doc_id", "ok")


def result_error(status: Column, hypothesis: Column, evidence: Column, fix: Column, fallback: Column, confidence: Column) -> Column:
    """What is wrong with the shape of a diagnosis: a diagnosed one needs a hypothesis, evidence and a fix and has no fallback; a
    fallback has only itself, at no confidence."""
    diagnosed = F.when(hypothesis.isNull(), "no hypothesis").when(evidence == 0, "no evidence").when(fix.isNull(), "no fix").when(fallback.isNotNull(), "fallback beside a diagnosis")
    safe = F.when(hypothesis.isNotNull() | fix.isNotNull() | (evidence > 0), "ungrounded diagnosis").when(fallback.isNull(), "no fallback").when(confidence != 0, "confident fallback")
    return F.when((confidence < 0) | (confidence > 1), "confidence out of range").when(status == "diagnosed", diagnosed).otherwise(safe)


@query(
    "diagnosis_shape",
    """SELECT event_id, CASE WHEN event_id%7=6 THEN 'confidence out of range' WHEN k%2=0 THEN CASE WHEN event_id%5=0 THEN 'no hypothesis' WHEN k%4=0 THEN 'no evidence' WHEN event_id%5=1 THEN 'no fix' WHEN event_id%5=2 THEN 'fallback beside a diagnosis' END
    ELSE CASE WHEN event_id%3<>0 THEN 'ungrounded diagnosis' WHEN event_id%5<>2 THEN 'no fallback' WHEN event_id%4<>0 THEN 'confident fallback' END END AS error FROM alerts""",
    ALERTS,
)
def diagnosis_shape(f: Frames) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    status = F.when(k % 2 == 0, "diagnosed").otherwise("fallback")
    diagnosed = k % 2 == 0
    hypothesis, fix = F.when(F.when(diagnosed, e % 5 != 0).otherwise(e % 3 == 1), "h"), F.when(F.when(diagnosed, e % 5 != 1).otherwise(e % 3 == 2), "f")
    evidence = F.when(diagnosed & (k % 4 != 0), 1).otherwise(0)
    error = result_error(status, hypothesis, evidence, fix, F.when(e % 5 == 2, "b"), F.when(e % 7 == 6, 1.5).when(~diagnosed & (e % 4 == 0), 0.0).otherwise(0.5))
    return f.alerts().select("event_id", error.alias("error"))


_WORD = r"[\t-\r\x20]"
_CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '[source code omitted]', 'g'), '(?s)-----BEGIN [^-]+-----.*?-----END [^-]+-----', '[secret omitted]', 'g'),
  '\b(?:gh[pousr]_[A-Za-z0-9_]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}})\b', '[GitHub token omitted]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/-]{{8,}}', 'Bearer [token omitted]', 'g'),
  '(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*[''"]?[^\s,;\])''"]{{6,}}', '[secret omitted]', 'g')"""
_LINES = rf"""array_to_string(list_transform(string_split(c, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\s*(?:async\s+def\b|(?:def|class|function|import|from|return|const|let|var|package|#include)\b|[A-Za-z_][A-Za-z0-9_.]*\s*=\s*[^=])') THEN '[source code omitted]' ELSE x END), ' ')"""


@query("sanitize_text", rf"SELECT doc_id, coalesce(nullif(trim(regexp_replace({_LINES}, '\s+', ' ', 'g')), ''), CASE WHEN c IS NOT NULL THEN '[details omitted]' END) AS clean FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)")
def sanitize_text(f: Frames) -> DataFrame:
    """Every rule over every whole text."""
    return f.table("documents").select("doc_id", T.sanitize_text(F.col("text")).alias("clean"))


@query(
    "incident_signals",
    "SELECT incident_id, array_to_string(list_sort(list_distinct([service, alertname, summary, scope_key, 'cluster', 'environment', 'pod'] || l)), ',') AS signals FROM incidents JOIN (SELECT inc, arg_max([cluster, environment, pod], seq) AS l FROM o GROUP BY inc) ON inc=incident_id",
    INCIDENTS,
)
def incident_signals(f: Frames) -> DataFrame:
    """What an incident says of itself, by its latest event: its fields, and its labels' names and values."""
    latest = f.o().groupBy(F.col("inc").alias("incident_id")).agg(F.max_by("labels", F.struct("ingested_ms", "event_id")).alias("labels"))
    rows = f.incidents().join(latest, "incident_id")
    said = F.concat(F.array("service", "alertname", "summary", "scope_key"), F.map_keys("labels"), F.map_values("labels"))
    return rows.select("incident_id", F.array_join(F.array_sort(F.array_distinct(said)), ",").alias("signals"))


@query("snapshot_inventory", f"WITH {_FILES} SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE doc_id%19<>0 GROUP BY source")
def snapshot_inventory(f: Frames) -> DataFrame:
    """Blobs of a snapshot (one entry in nineteen is a tree), each path once."""
    blobs = files(f).filter("doc_id % 19 <> 0").dropDuplicates(["source", "path"])
    return blobs.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


# repositories


@query(
    "repository_listing",
    "SELECT s_suppkey, s_name, n_name, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand),'') AS services FROM supplier JOIN nation ON n_nationkey=s_nationkey LEFT JOIN (SELECT *, p_partkey%100 AS k FROM part) p ON k=s_suppkey GROUP BY ALL",
)
def repository_listing(f: Frames) -> DataFrame:
    services = f.table("part").groupBy((F.col("p_partkey") % 100).alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("services"))
    named = f.table("supplier").join(f.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(services, "s_suppkey", "left")
    return named.select("s_suppkey", "s_name", "n_name", F.coalesce("services", F.lit("")).alias("services"))


@query(
    "service_snapshot",
    """SELECT service, s_suppkey, n_name, revision, snapshot FROM (SELECT p_brand AS service, s_suppkey, n_name, coalesce(v.revision, 0) AS revision, b.p_partkey AS snapshot,
    row_number() OVER (PARTITION BY p_brand ORDER BY b.p_retailprice DESC NULLS LAST, b.p_partkey DESC) AS rn
    FROM (SELECT p_brand, min(p_partkey%100) AS repo FROM part GROUP BY p_brand) m JOIN supplier ON s_suppkey=repo AND s_acctbal>-1000000 JOIN nation ON n_nationkey=s_nationkey
    LEFT JOIN (SELECT c_nationkey, count(*) AS revision FROM customer GROUP BY c_nationkey) v ON v.c_nationkey=n_nationkey
    LEFT JOIN (SELECT p_partkey, p_retailprice, p_partkey%100 AS k FROM part) b ON b.k=s_suppkey) WHERE rn=1""",
)
def service_snapshot(f: Frames) -> DataFrame:
    """A service's newest snapshot: by its mapping to a repository, the repository's installation, the installation's state
    revision (if any) and the repository's snapshots (if any)."""
    part = f.table("part")
    mapping = part.groupBy(F.col("p_brand").alias("service")).agg(F.min(F.col("p_partkey") % 100).alias("s_suppkey"))
    versions = f.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("revision"))
    newest = part.groupBy((F.col("p_partkey") % 100).alias("s_suppkey")).agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("snapshot"))
    repos = f.table("supplier").join(f.table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = mapping.join(repos, "s_suppkey").join(versions, "n_nationkey", "left").join(newest, "s_suppkey", "left")
    return rows.select("service", "s_suppkey", "n_name", F.coalesce("revision", F.lit(0)).alias("revision"), "snapshot")


def installation_status(action: Column, suspended: Column, selection: Column, permissions: Column) -> Column:
    """An installation that is broader than read access to selected repositories is not active. permissions: a map."""
    allowed = F.create_map(F.lit("contents"), F.lit("read"), F.lit("metadata"), F.lit("read"))
    same = F.array_sort(F.map_entries(permissions)) == F.array_sort(F.map_entries(allowed))
    status = F.when(action == "deleted", "deleted").when(suspended, "suspended").when(selection != "selected", "repository_selection_required")
    return status.when(~same, "permission_misconfigured").otherwise("active")


@query(
    "installation_status",
    "SELECT c_custkey, CASE WHEN c_custkey%11=0 THEN 'deleted' WHEN c_custkey%7=0 THEN 'suspended' WHEN c_custkey%5=0 THEN 'repository_selection_required' WHEN c_custkey%3<>2 THEN 'permission_misconfigured' ELSE 'active' END AS status FROM customer",
)
def installation_states(f: Frames) -> DataFrame:
    """Permissions of a third of them are too wide, of another too narrow."""
    k, read = F.col("c_custkey"), F.lit("read")
    grants = F.when(k % 3 == 0, F.create_map(F.lit("metadata"), read, F.lit("contents"), F.lit("write"))).when(k % 3 == 1, F.create_map(F.lit("metadata"), read)).otherwise(F.create_map(F.lit("metadata"), read, F.lit("contents"), read))
    status = installation_status(F.when(k % 11 == 0, "deleted").otherwise("created"), k % 7 == 0, F.when(k % 5 == 0, "all").otherwise("selected"), grants)
    return f.table("customer").select("c_custkey", status.alias("status"))


@query(
    "installation_state",
    "SELECT n_nationkey, n_name, s_suppkey, p_partkey AS snapshot FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey LEFT JOIN (SELECT p_partkey, p_partkey%100 AS k FROM part) p ON k=s_suppkey",
)
def installation_state(f: Frames) -> DataFrame:
    """Installations with their repositories and those with their snapshots, where they have any."""
    snapshots = f.table("part").select(F.col("p_partkey").alias("snapshot"), (F.col("p_partkey") % 100).alias("s_suppkey"))
    repos = f.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return f.table("nation").select("n_nationkey", "n_name").join(repos, "n_nationkey", "left").join(snapshots, "s_suppkey", "left").select("n_nationkey", "n_name", "s_suppkey", "snapshot")


def replaced(known: DataFrame, listed: DataFrame, revisions: DataFrame) -> DataFrame:
    """installation, repository, selected after a sync: what is listed is selected, all else is not. A list that was loaded at
    another revision of its installation than the current one changes nothing. known: with selected; listed: with expected."""
    current = listed.join(revisions, "installation").withColumn("holds", F.col("expected") == F.col("revision"))
    holds = current.groupBy("installation").agg(F.bool_and("holds").alias("holds"))
    rows = known.join(current.filter("holds").select("installation", "repository", F.lit(True).alias("listed")), ["installation", "repository"], "full")
    synced = rows.join(holds, "installation", "left")
    return synced.select("installation", "repository", F.when(F.coalesce("holds", F.lit(False)), F.coalesce("listed", F.lit(False))).otherwise(F.coalesce("selected", F.lit(False))).alias("selected"))


@query(
    "repo_replace_sync",
    """WITH known AS (SELECT s_nationkey AS i, s_suppkey AS r, s_suppkey%2=0 AS sel FROM supplier), listed AS (SELECT DISTINCT p_partkey%25 AS i, p_partkey%150 AS r FROM part), ok AS (SELECT i, i%4<>3 AS holds FROM (SELECT DISTINCT i FROM listed))
    SELECT coalesce(k.i, l.i) AS installation, coalesce(k.r, l.r) AS repository, CASE WHEN coalesce(o.holds,false) THEN l.r IS NOT NULL ELSE coalesce(k.sel, false) END AS selected
    FROM known k FULL OUTER JOIN (SELECT listed.* FROM listed JOIN ok USING (i) WHERE holds) l ON k.i=l.i AND k.r=l.r LEFT JOIN ok o ON o.i=coalesce(k.i, l.i)""",
)
def repo_replace_sync(f: Frames) -> DataFrame:
    """Inventories of all installations; a quarter of them were loaded before their installation changed."""
    known = f.table("supplier").select(F.col("s_nationkey").cast("long").alias("installation"), F.col("s_suppkey").alias("repository"), (F.col("s_suppkey") % 2 == 0).alias("selected"))
    key = F.col("p_partkey") % 25
    listed = f.table("part").select(key.alias("installation"), (F.col("p_partkey") % 150).alias("repository"), F.when(key % 4 == 3, 1).otherwise(2).alias("expected")).distinct()
    revisions = f.table("nation").select(F.col("n_nationkey").cast("long").alias("installation"), F.lit(2).alias("revision"))
    return replaced(known, listed, revisions)
