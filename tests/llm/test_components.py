import random

from cleanloom.llm._common import Scratch
from cleanloom.llm.components import connected_components


def test_against_union_find(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(300, 340)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(7, 7), (None, 4), edges[0]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(spark, df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root}


def test_no_edges(spark):
    assert connected_components(spark, spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
