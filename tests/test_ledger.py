"""The segmented ledger: chains by a plain loop, damage of each kind found where it begins, batches appended once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ledger

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
ALERTS = "event_id long, status string, message string, fired_ms long, ingested_ms long"


@pytest.fixture(autouse=True)
def short_segments(monkeypatch):
    monkeypatch.setattr(ledger, "SEGMENT", 8)


def alerts(spark, ids):
    return spark.createDataFrame([(k, "firing", None if k % 9 == 4 else f"m{k}", 1000 * k, 1_700_000_000_000 + 40 * (k // 3)) for k in ids], ALERTS)


def test_segments_and_their_seals_equal_a_loop(spark):
    rows = {r.seq: r for r in ledger.segmented(alerts(spark, range(100))).collect()}
    level, heads = 0, []
    for seq in range(1, 101):
        k, last = seq - 1, ledger.GENESIS if (seq - 1) % 8 == 0 else rows[seq - 1].row_hash
        text = f"firing|{1000 * k}" if k % 9 == 4 else f"firing|m{k}|{1000 * k}"
        assert (rows[seq].event_id, rows[seq].segment, rows[seq].prev_hash, rows[seq].row_hash) == (k, (seq - 1) // 8 * 8 + 1, last, sha(last + text))
    want, heads = {}, [(s, min(8, 101 - s), rows[min(s + 7, 100)].row_hash) for s in range(1, 101, 8)]
    while True:
        want |= {(level, s): (n, h) for s, n, h in heads}
        if len(heads) == 1:
            break
        level, texts, heads = level + 1, [f"{h}:{n}" for _, n, h in heads], []
        for s in range(0, len(texts), 8):
            last = ledger.GENESIS
            for text in texts[s : s + 8]:
                last = sha(last + text)
            heads.append((s + 1, len(texts[s : s + 8]), last))
    assert {(r.level, r.segment): (r.n, r.head) for r in ledger.sealed(ledger.segmented(alerts(spark, range(100)))).collect()} == want


def test_damage_is_found_where_it_begins(spark, tmp_path):
    ledger.segmented(alerts(spark, range(100))).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    ledger.sealed(rows).write.parquet(str(tmp_path / "seals"))
    seals = spark.read.parquet(str(tmp_path / "seals"))
    found = lambda r, s=seals: sorted(tuple(x) for x in ledger.verified(r, s).collect())
    assert found(rows) == []
    seq, damaged = F.col("seq"), rows
    damaged = damaged.withColumn("payload", F.when(seq == 5, "other").otherwise(F.col("payload")))  # changed
    damaged = damaged.filter(~seq.isin(12, 13))  # lost within a segment
    damaged = damaged.filter(~seq.isin(23, 24))  # the end of a segment
    damaged = damaged.withColumn("seq", F.when(seq == 27, 30).when(seq == 30, 27).otherwise(seq))  # swapped
    damaged = damaged.filter("segment <> 33").unionByName(rows.filter("seq = 43").withColumn("event_id", F.lit(-1).cast("long")))  # a segment lost, a row twice
    damaged = damaged.filter("seq <= 98")  # the end of the ledger
    rewritten = ledger.chained(rows.filter("segment = 49").withColumn("payload", F.lit("new")).drop("prev_hash", "row_hash"))
    damaged = damaged.filter("segment <> 49").unionByName(rewritten)
    got = found(damaged)
    assert got == [(0, 1, 5, "changed"), (0, 9, 12, "lost"), (0, 17, 23, "truncated"), (0, 25, 27, "changed"), (0, 33, 33, "lost"), (0, 41, 43, "added"), (0, 49, 56, "resealed"), (0, 97, 99, "truncated")]
    # whoever seals a rewritten segment anew departs from the seals above
    again = seals.filter("level > 0 OR segment <> 49").unionByName(ledger._heads(rewritten, 0))
    assert found(rows.filter("segment <> 49").unionByName(rewritten), again) == [(1, 1, 1, "resealed"), (2, 1, 1, "resealed")]
    assert found(rows, seals.filter("level > 0 OR segment <> 49"))[0] == (0, 49, 49, "unsealed")
    assert found(rows.limit(0), seals.limit(0)) == []


def test_batches_are_appended_exactly_once(spark, tmp_path):
    folder, add = str(tmp_path / "ledger"), ledger.appender(str(tmp_path / "ledger"))
    for batch, ids in [(0, range(20)), (1, range(0)), (3, range(20, 31))]:
        add(alerts(spark, ids), batch)
    held = sorted(tuple(r) for r in ledger.appended(spark, folder).collect())
    assert [(r[0], r[2]) for r in held] == [(k + 1, k) for k in range(31)] and {r[1] for r in held} == {1, 9, 17, 21, 29}
    lines = sorted(tuple(r) for r in ledger._batches(spark, folder).collect())
    add(alerts(spark, range(20, 31)), 3)  # repeated
    alerts(spark, range(5)).limit(0).select(*(F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in ledger.ROWS.split(", ")))).write.parquet(f"{folder}/rows/4")  # broken off
    assert sorted(tuple(r) for r in ledger.appended(spark, folder).collect()) == held
    assert sorted(tuple(r) for r in ledger._batches(spark, folder).collect()) == lines
    assert ledger.broken_batches(spark, folder).count() == 0
    cut = [x for x in lines if x[0] != 1]
    spark.createDataFrame(cut, ledger.BATCHES).write.parquet(str(tmp_path / "cut/batches/all"))
    assert [tuple(r) for r in ledger.broken_batches(spark, str(tmp_path / "cut")).collect()] == [(3, "link")]


def test_a_stream_appends_what_arrives(spark, tmp_path):
    alerts(spark, range(30)).repartition(3).write.parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "ledger")
    source = spark.readStream.schema(ALERTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = source.writeStream.foreachBatch(ledger.appender(folder)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.seq for r in ledger.appended(spark, folder).collect())) == list(range(1, 31))
    assert {r.event_id for r in ledger.appended(spark, folder).collect()} == set(range(30)) and ledger.broken_batches(spark, folder).count() == 0
