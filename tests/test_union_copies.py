"""Unions of many polygons: copies add nothing, and neither a group nor a task grows with them."""

from pyspark.sql import functions as F
from regionloom.operators import dissolve

SCHEMA = "code string, geometry array<array<array<array<double>>>>"


def _united(spark, monkeypatch, shapes, points):
    """The union's area in parts, and the largest group and task that a level joined."""
    groups, tasks = [], []
    plain = dissolve._joined

    def joined(rows, by):
        groups.append(rows.groupBy(*by).count().agg(F.max("count")).first()[0])
        out = plain(rows, by)
        tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(dissolve, "_joined", joined)
    monkeypatch.setattr(dissolve, "POINTS_A_TASK", points, raising=False)
    df = spark.createDataFrame([("a", s) for s in shapes], SCHEMA)
    return dissolve.union_by(df, "code").first()["geometry"], max(groups), max(tasks)


def test_copies_of_a_polygon(spark, monkeypatch):
    square = lambda x: [[[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]]]
    geometry, most, _ = _united(spark, monkeypatch, [square(float(i % 3)) for i in range(3000)], 50_000)
    assert geometry == [[[[0.0, 0.0], [3.0, 0.0], [3.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]
    assert most == 3


def test_polygons_of_one_box(spark, monkeypatch):
    """600 corners cut off one square: their boxes are equal, their union is the square."""
    corner = lambda i: [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [i / 1000, 1.0], [0.0, i / 1000], [0.0, 0.0]]]]
    geometry, most, tasks = _united(spark, monkeypatch, [corner(i) for i in range(600)], 100)
    assert geometry == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]
    assert most <= 2 * dissolve.FAN
    assert tasks == 36  # 3,600 points
