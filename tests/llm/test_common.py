"""Shared helpers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lakeprobe.llm.common import components, join_groups


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_with_a_hub(spark):
    """One node in half of the edges: no task gathers its neighbours (the groups of a hub are broadcast)."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(0, 3000, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 + i - i % 2 for i in range(3000)}


def test_join_groups(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert join_groups(rows, groups, "k", "n", 100).count() == 100
