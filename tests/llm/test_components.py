"""Connected components against a plain union of sets."""

import random

from tidewatch.llm.components import components


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {x: root(x) for x in parent}


def check(spark, edges):
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(11)).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == plain(edges)


def test_chains_stars_and_random_graphs(spark):
    draw = random.Random(5)
    order = list(range(1, 80))
    draw.shuffle(order)
    chain = list(zip(order[:-1], order[1:], strict=True))
    star = [(500, 500 + k) for k in range(1, 60)] + [(600, 500)]
    loose = [(draw.randrange(1000, 1300), draw.randrange(1000, 1300)) for _ in range(150)]
    check(spark, chain + star + loose)


def test_self_links_repeats_and_no_edges(spark):
    check(spark, [(1, 1), (2, 3), (3, 2), (2, 3), (-4, 2), (9, 9)])
    check(spark, [])
