"""Queries give every row of their job: held against whole SQL, plain Python and inputs beyond the former cuts."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from tidewatch import catalog
from tidewatch.plans.duck import ALERTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_stream_deltas_give_every_ledger_row_and_pages_follow_each_other(spark, db):
    got = sorted(r.stream_id for r in catalog.QUERIES["stream_deltas"](spark, SF).collect())
    n = db.sql(f"WITH {ALERTS} SELECT count(*) FROM o").fetchall()[0][0]
    assert got == [s * 10 + i for s in range(1, n + 1) for i in (1, 2, 3, 4) if s * 10 + i > 12]

    from tidewatch.operators import folds, incidents
    from tidewatch.plans.delivery import delta_page
    from tidewatch.sources.alerts import ordinary, read_alerts

    rows = ordinary(read_alerts(spark, SF))
    edges = spark.createDataFrame([], "src string, dst string")
    ledger, table = folds.ledger(rows), incidents.incidents(rows)
    first = [r.stream_id for r in delta_page(ledger, table, edges, 0, rows=3).collect()]
    assert first == [11, 12, 13, 14, 21, 22, 23, 24, 31, 32, 33, 34]
    assert [r.stream_id for r in delta_page(ledger, table, edges, 32, rows=2).collect()] == [33, 34, 41, 42, 43, 44]
    with pytest.raises(ValueError, match="negative"):
        delta_page(ledger, table, edges, -1)


#: Texts and what is left of each, rule by rule.
CLEANED = [
    ("see ```py\nx = 1\n``` and ``` open", "see [source code omitted] and ``` open"),
    ("a -----BEGIN RSA KEY-----\nabc\n-----END RSA KEY----- b", "a [secret omitted] b"),
    ("-----BEGIN X----- and no end", "-----BEGIN X----- and no end"),
    ("ghp_" + "a1" * 12 + " xghp_" + "a1" * 12, "[GitHub token omitted] xghp_" + "a1" * 12),
    ("github_pat_" + "b" * 20 + " github_pat_short", "[GitHub token omitted] github_pat_short"),
    ("bearer abcdefgh.ijk Bearer short", "Bearer [token omitted] Bearer short"),
    ("api_key: 'abcdef1' x", "[secret omitted]' x"),
    ("token : abcdef99, PASSWORD=short", "[secret omitted], PASSWORD=short"),
    ("mytoken=abcdef stays", "[source code omitted]"),
    ("ok\n  async  def f\nreturned\nreturn 1", "ok [source code omitted] returned [source code omitted]"),
    ("#include <x>\nx.y = 2\nx == 2", "[source code omitted] [source code omitted] x == 2"),
    ("one\r\ntwo\x85class A\u2028let it", "one two [source code omitted] [source code omitted]"),
    ("d\u00e9finition\nclass\u00e9", "d\u00e9finition class\u00e9"),
    (" \n\t\u3000", "[details omitted]"),
    ("", "[details omitted]"),
    ("word " * 1000, ("word " * 1000).strip()),
    (None, None),
]


def test_sanitize_text_rule_by_rule_and_whole_documents(spark):
    from tidewatch.functions.text import sanitize_text

    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CLEANED)], "k int, t string")
    for maximum in (None, 30):
        got = {r.k: r.c for r in rows.select("k", sanitize_text(rows.t, maximum).alias("c")).collect()}
        assert got == {k: clean and clean[:maximum] for k, (_, clean) in enumerate(CLEANED)}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.clean for r in catalog.QUERIES["sanitize_text"](spark, SF).collect()}
    assert got.keys() == docs.keys() and max(map(len, got.values())) > 80
    plain = [k for k, t in docs.items() if t.strip() and "=" not in t and ":" not in t and got[k].count("omitted") == 0]
    assert len(plain) > 20 and all(got[k].split() == docs[k].split() for k in plain)


def test_openings_without_an_end_take_linear_time(spark):
    import time

    from tidewatch.functions.text import sanitize_text

    began = time.time()
    rows = spark.createDataFrame([("-----BEGIN A----- x " * 20_000,), ("-----BEGIN A----- x " * 20_000 + "-----END A----- y",)], "t string")
    first, second = (r.c for r in rows.select(sanitize_text(rows.t).alias("c")).collect())
    assert first.count("BEGIN") == 20_000 and second == "[secret omitted] y"
    assert time.time() - began < 20


def test_paths_that_may_be_written(spark):
    from tidewatch.functions.text import patch_path

    good = ["Makefile", "build/x", "a/.env", "src/con_.py", "d\u00e9/x", "x" * 512]
    bad = ["", "/a", "a//b", "a/../b", "./a", "a\\b", "a:b", "a./b", "a /b", "dir/CON.txt", "aux", "x" * 513, "\u00e9" * 300, "a\tb"]
    rows = spark.createDataFrame([(p,) for p in good + bad], "p string")
    assert {r.p for r in rows.filter(patch_path(rows.p)).collect()} == set(good)


def test_tree_walk_doubles_finds_cycles_and_keeps_its_bounds(spark, tmp_path):
    from tidewatch.operators import tree

    name = F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")
    chain = spark.range(65).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), name)
    found = {r.id: r for r in tree.walk(chain).collect()}
    assert {k: (r.path, r.depth, r.verdict) for k, r in found.items()} == {k: ("/".join(f"n{i}" for i in range(k + 1)), k, "ok") for k in range(65)}
    assert max(r.steps for r in found.values()) == 7
    with pytest.raises(ValueError, match="deeper than 2"):
        tree.walk(chain.filter("id < 4"), 2)
    with pytest.raises(ValueError, match="64 entries"):
        tree.walk(chain, max_entries=64)
    with pytest.raises(ValueError, match="63 inner"):
        tree.walk(chain, max_requests=63)
    # 1 -> 2 -> 3 -> 1 with 4 and 5 below; 7 below 6, whose parent is not there; a tree beside them
    odd = spark.createDataFrame([(1, 3, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, 4, None), (6, 99, "f"), (7, 6, "g"), (8, None, "h"), (9, 8, "i"), (10, 10, "self")], "id long, parent int, name string")
    assert {r.id: (r.path, r.verdict) for r in tree.walk(odd).collect()} == {**dict.fromkeys([1, 2, 3, 4, 5, 10], (None, "cycle")), 6: (None, "no parent"), 7: (None, "no parent"), 8: ("h", "ok"), 9: ("h/i", "ok")}
    assert tree.walk(chain.limit(0)).count() == 0
    keys = [1, 8, 64, 512, 4096, 32768, 262144, 2097152]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted((r.id, r.depth) for r in catalog.QUERIES["tree_walk"](spark, str(tmp_path)).collect()) == [(k, d) for d, k in enumerate(keys)]


def test_patch_plan_takes_long_documents_up_to_its_byte_bound(spark, tmp_path):
    sizes = {1: 100, 2: 9000, 3: 60000, 4: 70000, 7: 70000}
    rows = [(k, "s", "a line\n" * (n // 7), n) for k, n in sizes.items()]
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.operation for r in catalog.QUERIES["patch_plan"](spark, str(tmp_path)).collect()}
    assert got == {"s/1": "update", "s/2": "update", "s/3": "update", "s/7": "delete"}


def test_an_open_channel_alone_degrades_the_verdict(spark):
    from tidewatch.operators import folds
    from tidewatch.plans.delivery import NOW, channel_signals, verdict

    def outbox(https):
        rows = [(c, i, NOW + i, h, 1, "sent") for i, (c, h) in enumerate(https)]
        return spark.createDataFrame(rows, "channel string, outbox_id long, created_ms long, http int, k int, status string")

    alerts = spark.createDataFrame([(NOW, NOW)], "fired_ms long, ingested_ms long")
    bad = outbox([("slack", 503)] * 3 + [("email", 200)])
    assert tuple(channel_signals(folds.breaker(bad)).first()) == ("slack", 1)
    assert tuple(verdict(bad, alerts).first())[:2] == ("degraded", "channel-open")
    good = outbox([("slack", 503)] * 2 + [("slack", 200), ("email", 200)])
    assert tuple(channel_signals(folds.breaker(good)).first()) == ("", 0)
    assert tuple(verdict(good, alerts).first())[:2] == ("ok", "")
