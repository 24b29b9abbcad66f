"""Sessions against their SQL where alerts are exactly the gap apart, just short of it and just over."""

import duckdb

from tidewatch import catalog


def test_a_gap_of_five_minutes_parts_sessions(spark, tmp_path):
    gaps = {1: [300_000], 2: [299_999], 3: [300_001], 4: [299_999, 300_000, 0, 299_999]}
    rows = []
    for user, steps in gaps.items():
        at = 0
        for step in [0, *steps]:
            at += step
            rows.append((len(rows), user, at * 60))  # events are in time stretched by sixty
    events = spark.createDataFrame(rows, "event_id long, user_id long, at long")
    events.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, at / 1000) AS ts", "user_id", "'view' AS event_type", "0.0D AS value", "'{\"k\": 1}' AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["alert_sessions"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(db.execute(catalog.ORACLE_SQL["alert_sessions"]).fetchall())
    assert [(user, n) for user, _, n in got] == [(1, 1), (1, 1), (2, 2), (3, 1), (3, 1), (4, 2), (4, 3)]
