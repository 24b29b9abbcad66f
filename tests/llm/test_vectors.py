"""Delta Lloyd and Hamerly codes against plain loops over every vector, with the awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x string, distance string, n int"


def table(spark, dim, n, levels=4):
    """Vectors on few levels (many ties), repeated rows, rows without id, label or vector, and columns with clashing names."""
    r = random.Random(dim)
    rows = [(i, [r.randint(-levels, levels) / 8 for _ in range(dim)], r.choice([None, 0, 1, 2]), "k", "x", "d", 1) for i in range(n)]
    rows += [rows[3], rows[3], rows[5], (None, [0.5] * dim, 1, None, None, None, None), (7, [0.25] * dim, 1, None, None, None, None)]
    odd = [None, [], [0.1] * (dim - 1), [0.1] * (dim + 16), [float("nan")] + [0.0] * (dim - 1), [float("inf")] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1)]
    return spark.createDataFrame(rows + [(1000 + i, v, 1, None, None, None, None) for i, v in enumerate(odd)], SCHEMA).repartition(3), [(i, v, lab) for i, v, lab, *_ in rows]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, places, rounds):
    """Every vector meets every place in every round."""
    for left in range(rounds, -1, -1):
        owner = [min(range(len(places)), key=lambda c: (apart(p, places[c]), c)) for p in points]
        if not left:
            return owner, places
        for c in range(len(places)):
            mine = [p for p, o in zip(points, owner) if o == c]
            if mine:
                places = places[:c] + [[sum(col) // len(mine) for col in zip(*mine)]] + places[c + 1 :]


@pytest.mark.parametrize("n", [90, 5])
def test_delta_lloyd_equals_plain_rounds(spark, n):
    from tidewatch.llm.centroids import cluster_report

    df, rows = table(spark, 64, n + 6)
    points = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), p) for (i, _, _), p in zip(rows, points) if i is not None)
    owner, places = lloyd(points, [p for _, p in order[:8]], 10)
    distance = [apart(p, places[o]) for p, o in zip(points, owner)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    want = [(i, o, d, sum(x for x, q in zip(distance, owner) if q == o), sum(distance), digest[o]) for (i, _, _), o, d in zip(rows, owner, distance)]
    out = cluster_report(df, "vec_id", "embedding")
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_only_moved_centroids_are_compared():
    from tidewatch.llm.centroids import reassigned

    r = np.random.default_rng(1)
    x, before = r.integers(-3, 4, (500, 6)), r.integers(-3, 4, (5, 6))
    everything = np.ones(5, bool)
    owner, distance = reassigned(x, np.full(500, -1), np.zeros(500, np.int64), before, everything)
    assert owner.tolist() == [min(range(5), key=lambda c: (apart(p, before[c]), c)) for p in x]
    after = before.copy()
    after[[1, 4]] += 1
    moved = np.array([False, True, False, False, True])
    assert all((a == b).all() for a, b in zip(reassigned(x, owner, distance, after, moved), reassigned(x, np.full(500, -1), distance, after, everything)))


def test_codes_equal_plain_rounds(spark):
    from tidewatch.llm.veccodes import code_report, fit_codes

    df, rows = table(spark, 64, 150)
    points = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    first = [p for _, p in sorted((i, p) for (i, _, _), p in zip(rows, points) if i is not None)[:64]]
    codes, books, error = [""] * len(rows), [], [0] * len(rows)
    for p in range(16):
        part = [v[4 * p : 4 * p + 4] for v in points]
        owner, places = lloyd(part, [v[4 * p : 4 * p + 4] for v in first], 2)
        books += [x for c in places for x in c]
        codes = [c + f"{o:02x}" for c, o in zip(codes, owner)]
        error = [e + apart(v, places[o]) for e, v, o in zip(error, part, owner)]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    want = [(i, c, e, sum(x for x, (_, _, other) in zip(error, rows) if other == lab), digest) for (i, _, lab), c, e in zip(rows, codes, error)]
    out = code_report(df, "vec_id", "embedding", "label")
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())
    # bounds spare scans after the first round
    state, _ = fit_codes(df, "vec_id", "embedding", "label")
    assert sum(r.scans for r in state.collect()) < 3 * 16 * len(rows)


def test_hamerly_bounds_keep_ties_and_spare_scans():
    from tidewatch.llm.veccodes import hamerly, moves, scanned

    r = np.random.default_rng(2)
    for spread in (3, 200, 100_000):
        x, before = r.integers(-spread, spread, (2000, 4)), r.integers(-spread, spread, (16, 4))
        code, upper, lower = scanned(x, before)
        spared = 0
        for _ in range(6):
            after = before + r.integers(-1, 2, before.shape) * r.integers(0, 2, (16, 1))
            own, others = moves(before[None], after[None])
            code, upper, lower, full = hamerly(x, after, code, upper, lower, own[0], others[0])
            assert (code == scanned(x, after)[0]).all()
            spared += len(x) - len(full)
            before = after
        assert spared > 0 or spread == 3


def test_no_vectors_no_rows(spark):
    from tidewatch.llm.centroids import cluster_report
    from tidewatch.llm.veccodes import code_report

    for rows in ([], [(1, None, 1, None, None, None, None)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert cluster_report(df, "vec_id", "embedding").collect() == []
        assert code_report(df, "vec_id", "embedding", "label").collect() == []
    with pytest.raises(Exception, match="beyond"):
        cluster_report(spark.createDataFrame([(1, [1e30] * 64, 1, None, None, None, None)], SCHEMA), "vec_id", "embedding").collect()
