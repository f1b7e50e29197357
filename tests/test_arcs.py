"""Shapes simplified together: shared borders stay shared, small parts go with their borders, nothing vanishes."""

from pyspark.sql import functions as F
from regionloom.operators import arcs, rings


def square(x, y, w=1.0):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


def rows(spark, features):
    """features: id -> parts of rings of points."""
    out = [(f, p, r, i, float(x), float(y)) for f, parts in features.items() for p, rs in enumerate(parts) for r, ring in enumerate(rs) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(out, "feature long, part int, ring int, pos int, x double, y double")


def shapes(df):
    return {r["feature"]: [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in r["geometry"]] for r in df.collect()}


def length(b):
    return sum(((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2) ** 0.5 for p, q in zip(b["line"], b["line"][1:]))


def test_a_shared_border_is_simplified_identically(spark):
    wiggle = [(10 + (0.3 if i % 2 == 0 else -0.2), float(i)) for i in range(1, 100)]
    west = [(0, 0), (10, 0), *wiggle, (10, 100), (0, 100), (0, 0)]
    east = [(10, 100), *reversed(wiggle), (10, 0), (20, 0), (20, 100), (10, 100)]
    got, _ = arcs.simplify_shared(rows(spark, {1: [[west]], 2: [[east]]}), 0.5)
    border = [{p for p in g[0][0] if 9 < p[0] < 11} for g in shapes(got).values()]
    assert border[0] == border[1] and 2 <= len(border[0]) < 99


def test_one_arc_between_two_features(spark):
    got, borders = arcs.simplify_shared(rows(spark, {1: [[square(0, 0)]], 2: [[square(1, 0)]]}), 0.0)
    b = borders.collect()
    assert len(shapes(got)) == 2 and [length(x) for x in b if x["b"] is not None] == [1.0]
    assert sum(length(x) for x in b if x["b"] is None) == 6.0
    one = next(x for x in b if x["b"] is not None)
    assert (one["a"], one["b"], one["interior_left"]) == (1, 2, None)


def test_outlines_know_their_side(spark):
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    for turn in (1, -1):
        df = rows(spark, {1: [[square(0, 0, 4.0)[::turn], hole]], 2: [[square(0, 0, 4.0), hole[::-1]]], 3: [[square(9, 9)[::-turn]]]}).where("feature <> 2")
        for b in arcs.simplify_shared(df, 0.0)[1].collect():
            p, q = b["line"][0], b["line"][1]
            mx, my, nx, ny = (p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2, p["y"] - q["y"], q["x"] - p["x"]
            s = 0.01 if b["interior_left"] else -0.01
            x, y = mx + s * nx, my + s * ny
            inside = (0 < x < 4 and 0 < y < 4 and not (1 < x < 2 and 1 < y < 2)) if b["a"] == 1 else (9 < x < 10 and 9 < y < 10)
            assert inside


def test_a_cut_inside_one_feature_is_no_border(spark):
    _, borders = arcs.simplify_shared(rows(spark, {1: [[square(0, 0)], [square(1, 0)]]}), 0.0)
    b = borders.collect()
    assert all(x["b"] is None for x in b) and sum(map(length, b)) == 6.0


def test_small_islands_take_their_borders_with_them(spark):
    df = rows(spark, {1: [[square(0, 0)], [[(5, 5), (5.1, 5), (5.1, 5.1), (5, 5)]]], 2: [[[(7, 7), (7.1, 7), (7.1, 7.1), (7, 7)]]]})
    got, borders = arcs.finish(df, a := arcs.ring_arcs(df), arcs.simplified(a, 0.0), 0.5, F.col("feature") > 5)
    found = shapes(got)
    assert len(found[1]) == 1 and found[2] == [] and sum(map(length, borders.collect())) == 4.0
    kept, _ = arcs.finish(df, a, arcs.simplified(a, 0.0), 0.5)
    assert {k: len(v) for k, v in shapes(kept).items()} == {1: 1, 2: 1}


def test_nothing_vanishes_and_zero_changes_nothing(spark):
    speck = [(0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001), (0, 0)]
    holed = [square(10, 10, 8.0), square(12, 12, 1.0)]
    df = rows(spark, {1: [[speck]], 2: [holed]})
    assert shapes(arcs.simplify_shared(df, 1000.0)[0])[1] == [[[tuple(map(float, p)) for p in speck]]]
    same = shapes(arcs.simplify_shared(df, 0.0)[0])
    assert {len(r) for r in same[2][0]} == {5} and len(same[2][0]) == 2
    areas = {r["feature"]: r["a"] for r in arcs.simplify_shared(df, 0.0)[0].select("feature", arcs.shape_area("geometry").alias("a")).collect()}
    assert abs(areas[2] - 63) < 1e-12 and abs(areas[1] - 1e-6) < 1e-12
    got, borders = arcs.simplify_shared(df.limit(0), 1.0)
    assert got.count() == 0 and borders.count() == 0
    assert rings.clean_rings(df).count() == df.count()
