"""Box, point and segment joins on the pyramid of grids, against all pairs; rows a box are few whatever its size."""

import math
import random

from pyspark.sql import functions as F
from regionloom.operators import dissolve, overlay, spatial

BOXES = "id long, x0 double, y0 double, x1 double, y1 double"


def made(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = 10 ** rng.uniform(-6, 2) if rng.random() < 0.9 else 0.0
        x, y = rng.uniform(-180, 180 - w), rng.uniform(-90, 90)
        if rng.random() < 0.5:
            x, y = rng.choice([-10.0, 0.0, 12.5]), rng.choice([0.0, 5.0])
        rows.append((i, x, y, x + w, y + w * rng.random()))
    return [*rows, (900, -180.0, -90.0, 180.0, 90.0), (901, 0.0, 0.0, 0.0, 0.0)]


def test_box_pairs(spark):
    a, b = made(1), made(2)
    for pad in (0.0, 0.3):
        got = [(r["id"], r["id_b"]) for r in spatial.box_pairs(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), 0.01, pad).collect()]
        want = {(p[0], q[0]) for p in a for q in b if p[1] - 2 * pad <= q[3] and q[1] - 2 * pad <= p[3] and p[2] - 2 * pad <= q[4] and q[2] - 2 * pad <= p[4]}
        assert len(got) == len(set(got)) and set(got) == want


def test_rows_a_box_are_bounded(spark):
    df = spark.createDataFrame([*made(3), (1000, -180.0, -90.0, 180.0, 90.0)], BOXES)
    home = spatial.at_home(df, 1e-6).groupBy("id").count()
    assert home.agg(F.max("count")).first()[0] <= 4
    levels = spatial.levels_of(spatial.leveled(df, 1e-6))
    assert spatial.visiting(df, 1e-6, levels).groupBy("id", "level").count().agg(F.max("count")).first()[0] <= 4
    odd = spark.createDataFrame([(1, float("nan"), 0.0, 1.0, 1.0), (2, None, 0.0, 1.0, 1.0), (3, 0.0, 0.0, float("inf"), 1.0)], BOXES)
    assert spatial.box_pairs(odd, df, 1.0).count() == 0 and spatial.box_pairs(df.limit(0), df, 1.0).count() == 0


def test_long_segments_are_walked(spark):
    rng = random.Random(4)
    segments = [(0, 0.0, 0.0, 10.0, 7.0), (1, 0.0, 0.0, 0.001, 0.0), (2, 5.0, 5.0, 5.0, 5.0), (3, -180.0, 10.0, 180.0, 10.0), (4, 1.0, -80.0, 1.0, 80.0)]
    seg = spark.createDataFrame(segments, "sid long, ax double, ay double, bx double, by double")
    tolerance = 0.0005
    assert spatial._walked(seg, 4 * tolerance, tolerance).groupBy("sid").count().agg(F.max("count")).first()[0] <= 9 * spatial.PIECES
    points = []
    for i in range(400):
        s = rng.choice(segments)
        t, o = rng.random(), rng.choice([0.0, 0.0004, 0.0006, -0.00049, 1.0])
        points.append((i, s[1] + t * (s[3] - s[1]), s[2] + t * (s[4] - s[2]) + o))

    def distance(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        n = dx * dx + dy * dy
        t = 0 if n == 0 else max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / n))
        return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)

    got = {(r["pid"], r["sid"]) for r in spatial.nearest_segment(spark.createDataFrame(points, "pid long, x double, y double"), seg, tolerance).collect()}
    near = {(p[0], s[0]) for p in points for s in segments if distance(p, s) <= tolerance}
    edge = {(p[0], s[0]) for p in points for s in segments if abs(distance(p, s) - tolerance) < 1e-12}
    assert near - edge <= got <= near | edge and len(near) > 100


def test_clusters_over_the_seam_and_along_a_latitude(spark):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        x, y = rng.uniform(-180, 179), rng.choice([0.0, 50.0, 80.0, rng.uniform(-89, 88)])
        rows.append((i, x, y, x + rng.random(), y + rng.random()))
    df = spark.createDataFrame(rows, BOXES)
    both = df.crossJoin(df.select(*[F.col(c).alias(f"{c}_b") for c in df.columns])).where("id < id_b").where(spatial.box_gap_km() <= 700)
    want = {(r["id"], r["id_b"]) for r in both.collect()}
    got = [(r["u"], r["v"]) for r in spatial.cluster_edges(df, 700.0).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10


def test_points_in_polygons_of_all_sizes(spark):
    e = lambda x0, y0, x1, y1: [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]
    boxes = [b for b in made(7, 60) if b[3] > b[1] and b[4] > b[2]]
    df = spark.createDataFrame([(*b, e(*b[1:])) for b in boxes], BOXES + ", edges array<struct<x0:double,y0:double,x1:double,y1:double>>")
    rng = random.Random(8)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(100)] + [(100 + i, (b[1] + b[3]) / 2, (b[2] + b[4]) / 2) for i, b in enumerate(boxes)]
    got = [(r["pid"], r["id"]) for r in spatial.points_in_polygons(spark.createDataFrame(points, "pid long, x double, y double"), df, 0.001).collect()]
    inside = {(p[0], b[0]) for p in points for b in boxes if b[1] < p[1] < b[3] and b[2] < p[2] < b[4]}
    touched = {(p[0], b[0]) for p in points for b in boxes if b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4]}
    assert len(got) == len(set(got)) and inside <= set(got) <= touched


def test_union_by_groups(spark):
    square = lambda x, y, w=1.0: [[[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]]
    rows = [("a", i, square(float(i % 20), float(i // 20))) for i in range(400)] + [("b", 0, square(0.0, 0.0)), ("b", 1, square(1.0, 1.0)), ("c", 0, None), ("d", 0, []), (None, 0, square(5.0, 5.0))]
    rows += [("e", i, square(0.0, 0.0)) for i in range(150)]  # copies
    df = spark.createDataFrame(rows, "code string, pos long, geometry array<array<array<array<double>>>>")
    got = {r["code"]: r["geometry"] for r in dissolve.union_by(df, "code", 7).collect()}
    assert got["a"] == square(0.0, 0.0, 20.0) and len(got["b"]) == 2 and got["c"] == [] and got["d"] == [] and got["e"] == square(0.0, 0.0)
    assert None not in got
    refs = dissolve.grouped_references(df.withColumn("up", F.when(F.col("pos") > 0, "later")), F.col("code"), F.col("up"), "X-")
    assert {(r["code"], r["parent"]) for r in refs.collect()} == {("X-a", None), ("X-b", None), ("X-c", None), ("X-d", None), ("X-e", None)}


def test_grouped_references_match_parent_level_units(spark):
    """Two units of one region, united, are half of a shape twice their size."""
    square = lambda x, y, w, h: [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]]
    both = overlay.unions([[square(0, 0, 1, 1), square(1, 0, 1, 1)]])[0]
    df = spark.createDataFrame([(1, square(0.0, 0.0, 2.0, 2.0))], "id long, geometry array<array<array<array<double>>>>").withColumns(spatial.polygon_box("geometry"))
    ref = spark.createDataFrame([("R", both)], "id string, geometry array<array<array<array<double>>>>").withColumns(spatial.polygon_box("geometry"))
    p = spatial.box_pairs(df, ref, 1.0).withColumn("overlap", spatial.intersection_area("geometry", "geometry_b"))
    m = spatial.best_match(p, F.col("overlap"), spatial.polygon_area("geometry"), spatial.polygon_area("geometry_b"), 0.5).collect()
    assert [(r["id"], r["id_b"], r["overlap"]) for r in m] == [(1, "R", 2.0)]
    point = spark.createDataFrame([(1, [[[[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]]])], "id long, geometry array<array<array<array<double>>>>").withColumns(spatial.polygon_box("geometry"))
    p = spatial.box_pairs(point, ref, 1.0).withColumn("overlap", spatial.intersection_area("geometry", "geometry_b"))
    assert spatial.best_match(p, F.col("overlap"), spatial.box_area(), spatial.box_area("_b"), 0.0).count() == 0
    assert spatial.overlap_crosswalk(p, F.col("overlap"), spatial.box_area(), 0.0).count() == 0


def test_empty_and_null_shapes_reach_no_worker(spark):
    shape = [[[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]]]
    df = spark.createDataFrame([(1, shape, []), (2, [], []), (3, None, shape), (4, shape, None)], "id int, a array<array<array<array<double>>>>, b array<array<array<array<double>>>>").repartition(4, "id")
    got = {r["id"]: (r["i"], r["u"], len(r["s"])) for r in df.select("id", spatial.intersection_area("a", "b").alias("i"), spatial.union_area("a", "b").alias("u"), spatial.union_shape("a", "b").alias("s")).collect()}
    assert got == {1: (0.0, 0.5, 1), 2: (0.0, 0.0, 0), 3: (0.0, 0.5, 1), 4: (0.0, 0.5, 1)}
