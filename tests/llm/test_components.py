"""Components against union-find, on chains, stars and random edges."""

import random

from spanloom.llm.components import connected_components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(90)]
    edges += [(5, 5), (None, 3), (1, 0), (1, 0)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
