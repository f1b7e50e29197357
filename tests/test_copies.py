"""Rows that repeat meet once, and no pair of their copies is lost."""

import duckdb
from pyspark.sql import functions as F
from regionloom.operators import reshape, spatial

BOXES = "id long, x0 double, y0 double, x1 double, y1 double"


def _boxes(spark, first, n, kinds):
    return spark.createDataFrame([(first + i, i % kinds * 1.0, 0.0, i % kinds * 1.0 + 1.5, 1.0 + i % 2) for i in range(n)], BOXES)


def test_pairs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MEMBERS", 7)
    a, b = _boxes(spark, 0, 120, 4), _boxes(spark, 1000, 90, 6)
    plain = spatial.box_pairs(a, b, 2.0)
    (one, of_a), (other, of_b) = (spatial.copies(df, *spatial.BOX) for df in (a, b))
    assert (one.count(), other.count()) == (4, 6)
    pairs = spatial.box_pairs(one, other, 2.0).withColumn("overlap", spatial.box_overlap())
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spatial.of_all(pairs, of_a, of_b, ("overlap",))) == rows(plain.select("id", "id_b", spatial.box_overlap()))
    arguments = spatial.box_overlap(), spatial.box_area()
    assert rows(spatial.crosswalk_of_all(spatial.overlap_crosswalk(pairs, *arguments, 0.1), of_a, of_b)) == rows(spatial.overlap_crosswalk(plain, *arguments, 0.1))
    arguments = *arguments, spatial.box_area("_b"), 0.1
    assert rows(spatial.best_of_all(spatial.best_match(pairs, *arguments), of_a)) == rows(spatial.best_match(plain, *arguments))
    own = spatial.box_pairs(one, one, 2.0).where("id <= id_b")
    assert rows(spatial.self_overlaps_of_all(own, of_a, *arguments)) == rows(spatial.self_overlaps(spatial.box_pairs(a, a, 2.0), *arguments))


def test_small_weights_in_text(spark):
    """Below 0.0001 a weight is written with an exponent, as the query's SQL does."""
    w = [1e-06, 1e-05, 1.9e-05, 9.9e-05, 0.0001, 0.000123, 0.25, 1.0, 0.0]
    df = spark.createDataFrame([(f"{i}", "x", v) for i, v in enumerate(w)], "`from` string, `to` string, weight double")
    got = [r[0] for r in reshape.crosswalk_csv(df).collect()]
    con = duckdb.connect()
    said = [con.execute("SELECT regexp_replace(?::DOUBLE::VARCHAR, '\\.0$', '')", [v]).fetchall()[0][0] for v in w]
    assert got == [f"{i},x,{t}" for i, t in enumerate(said)]


def test_points_of_copies(spark):
    e = lambda a, b, c, d: F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1"))
    edges = F.array(e("x0", "y0", "x1", "y0"), e("x1", "y0", "x1", "y1"), e("x1", "y1", "x0", "y1"), e("x0", "y1", "x0", "y0"))
    polygons = _boxes(spark, 0, 60, 3).withColumn("edges", edges)
    points = spark.createDataFrame([(i, i % 5 + 0.25, 0.5) for i in range(50)], "pid long, x double, y double")
    got = sorted(map(tuple, spatial.points_in_polygons(points, polygons, 1.0).collect()))
    want = sorted((i, j) for i in range(50) for j in range(60) if j % 3 < i % 5 + 0.25 < j % 3 + 1.5)
    assert got == want
