"""The forest against brute force: recall, exact scores, and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from regionloom.llm import neighbours


def cosines(vectors, q):
    return np.array([float((v * q).sum() / math.sqrt((v * v).sum() * (q * q).sum())) for v in vectors])


def recall(rows, vectors, step, k=5):
    found, hit, total = {}, 0, 0
    for r in rows:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, len(vectors), step):
        s = cosines(vectors, vectors[q])
        s[q] = -9
        order = np.lexsort((np.arange(len(s)), -s))[:k]
        hit += len({int(i) for i in order} & {i for i, _ in found[q].values()})
        total += len(order)
        ranked = [found[q][i + 1] for i in range(len(found[q]))]
        assert all(abs(s[i] - x) < 1e-12 for i, x in ranked)
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))
    return hit / total


@pytest.mark.parametrize("kind", ["cloud", "clusters", "line"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 24))
    if kind == "clusters":
        v = 6 * rng.standard_normal((20, 24))[rng.integers(0, 20, 3000)] + 0.2 * v
    if kind == "line":
        v = rng.standard_normal(24) * 10 + rng.standard_normal(24) * np.linspace(-1, 1, 3000)[:, None] + 0.01 * v
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=1000, block_rows=25).collect()
    assert recall(got, v, 50) >= 0.95


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [2.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(9), "vector": F.lit("x"), "shard": F.lit(0)})
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=3).collect()]
    assert sorted(got) == [(0, 1, 10), (0, 2, 7), (0, 3, 8), (50, 1, 7), (50, 2, 8), (50, 3, 0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id <> 0"), F.col("vec_id") < 0).count() == 0


def test_copies_and_ids_of_several_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(40, [1.0, 2.0]), (40, [-1.0, 5.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"]: [] for r in got}.keys() == {0, 20, 40}
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 0) == [1, 2, 3, 4, 5]
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 40) == [0, 1, 2, 3, 4]


def test_stop_level():
    assert neighbours.stop_level(1.0, 96, 40, 0.05) == 40 and neighbours.stop_level(-1.0, 96, 40, 0.05) == 0
    p = 1 - math.acos(0.5) / math.pi
    x = neighbours.stop_level(0.5, 96, 40, 0.05)
    assert (1 - p**x) ** 96 <= 0.05 < (1 - p ** (x + 1)) ** 96
