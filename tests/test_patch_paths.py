"""Paths that may be written, of documents with and without a text, against the rules written out in Python."""

import re

from tidewatch import catalog
from tidewatch.functions import text as T
from tidewatch.plans import repository

SOURCES = ["src1", "src2", "con", "Com1.x", "clock$", "com0", "dir.", "dir ", "a:b", "a\\b", "a\tb", "a//b", ".", "..", "", None, "x" * 600, "é" * 300, "é/y", ".AWS", "vendor", "a/.env"]


def writable(path):
    parts = path.split("/")
    reserved = re.compile(r"con|prn|aux|nul|clock\$|(com|lpt)[1-9]", re.ASCII | re.IGNORECASE)
    short = len(path) <= 512 and len(path.encode()) <= 512
    return short and not re.search(r"[\x00-\x1f\\:]", path) and not any(p in ("", ".", "..") or p[-1] in ". " or reserved.fullmatch(p.split(".")[0]) for p in parts)


def readable(path):
    *above, name = path.lower().split("/")
    secret = {*above, name} & set(T.SECRET_DIRS) or name in T.SECRET_NAMES or name.startswith(".env.")
    return not set(above) & set(T.GENERATED) and not secret and not name.endswith((".map", ".min.css", ".min.js", ".lock")) and "." in name and name.rsplit(".", 1)[1] in T.SUFFIXES


def test_paths_of_every_document_whether_it_has_a_text_or_not(spark, tmp_path):
    import duckdb

    names = lambda listed: [n.strip("'") for n in listed.strip("[]").split(", ")]
    dirs, ends = names(repository._DIRS), names(repository._NAMES)
    rows = [(k * 130 + d, s, "a text" if d % 3 else None, 6) for k, s in enumerate(SOURCES) for d in range(130)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    paths = {d: f"{s}{dirs[d % 13]}f{d}{ends[d % 10]}" for d, s, *_ in rows if s is not None}
    expected = {(d, p, readable(p)) for d, p in paths.items() if writable(p)}
    got = [tuple(r) for r in catalog.QUERIES["patch_paths"](spark, str(tmp_path)).collect()]
    assert len(got) == len(expected) and set(got) == expected
    duckdb.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(duckdb.sql(catalog.ORACLE_SQL["patch_paths"]).fetchall()) == expected
    without = {d for d, _, text, _ in rows if text is None}
    assert {(d in without, r) for d, _, r in expected} == {(False, False), (False, True), (True, False), (True, True)}
    # what needs a file's content still has only documents with a text
    assert not without & {r.doc_id for r in catalog.QUERIES["language_hint"](spark, str(tmp_path)).collect()}
