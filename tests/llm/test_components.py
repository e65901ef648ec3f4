import random

import pytest
from pyspark.sql import functions as F

from edgeloom.llm.components import _scrambled, _unscrambled, components
from edgeloom.llm.tables import Workspace


def by_hand(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return root


def test_scramble_is_one_to_one(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, -1, 2**63 - 1, -(2**63), 12345678901, -77)], "x long")
    assert df.filter(_unscrambled(_scrambled(F.col("x"), 4), 4) != F.col("x")).count() == 0


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(400)] + [(i + 1000, i + 1001) for i in range(50)],
        "star": [(5, i) for i in range(6, 500)] + [(-3, 499)],
        "random": [(rng.randrange(600), rng.randrange(600)) for _ in range(330)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
        "none": [],
    }[kind]
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    got = {r.node: r.root for r in components(df, Workspace(spark, "t")).collect()}
    want = by_hand([e for e in edges if e[0] != e[1]])
    assert got == want
