import random

from leafwork.operators.graph import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {x: find(x) for x in list(root)}


def test_against_union_find(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(40)] + [(100, 100), (None, 7), (50, 51), (51, 50), (50, 51)], [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]):
        df = spark.createDataFrame(edges, "a long, b long")
        got = components(df)
        assert {r.node: r.component for r in got.collect()} == brute(edges)
    assert components(df.limit(0)).count() == 0
