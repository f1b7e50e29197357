"""Coast and land borders, frames on clusters, cuts at the seam."""

import numpy as np
from regionloom.operators import coast, frame, overlay, seam

EDGES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def boxed(i, x0, y0, x1, y1):
    return (i, x0, y0, x1, y1, [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)])


def test_an_outline_is_coast_and_land_border(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    rows = [("left", i, float(x), float(y), True) for i, (x, y) in enumerate(ring)]
    rows += [("right", i, float(x), float(y), False) for i, (x, y) in enumerate(ring[::-1])]
    rows += [("still", 0, 1.0, 1.0, True), ("still", 1, 1.0, 1.0, True)]
    lines = spark.createDataFrame(rows, "line string, pos int, x double, y double, interior_left boolean")
    near = spark.createDataFrame([boxed(1, 10.0, 0.0, 20.0, 10.0)], f"id long, x0 double, y0 double, x1 double, y1 double, edges {EDGES}")
    got = {}
    for r in coast.outline_runs(lines, near, 0.5, 1.0).orderBy("line", "run").collect():
        got.setdefault(r["line"], []).append((r["kind"], [(p["x"], p["y"]) for p in r["points"]]))
    assert [k for k, _ in got["left"]] == ["coast", "external", "coast"] and got["left"][1][1] == [(10, 0), (10, 10)]
    assert [k for k, _ in got["right"]] == ["coast", "external", "coast"] and got["right"][1][1] == [(10, 10), (10, 0)]
    assert "still" not in got
    assert {r["kind"] for r in coast.outline_runs(lines, near.limit(0), 0.5, 1.0).collect()} == {"coast"}


def parts(spark, squares):
    rows = [(i, i // 2, i % 2, x, y, x + s, y + s) for i, (x, y, s) in enumerate(squares)]
    return spark.createDataFrame(rows, "part long, feature long, at int, x0 double, y0 double, x1 double, y1 double")


def test_the_frame_drops_far_islands(spark):
    p = parts(spark, [(-2.0, 44.0, 4.0), (2.0, 44.0, 4.0), (8.5, 41.5, 1.0), (-54.0, 3.0, 4.5)])
    assert {r["part"] for r in frame.main_parts(p).collect()} == {0, 1, 2}
    ring = lambda x: [[[x, 0.0], [x + 1, 0.0], [x, 1.0]]]
    features = spark.createDataFrame([(0, [ring(0.0), ring(1.0)]), (1, [ring(2.0), ring(3.0)]), (2, [ring(4.0)])], "feature long, geometry array<array<array<array<double>>>>")
    cut, f = frame.framed(features, p)
    assert {r["feature"]: r["geometry"] for r in cut.collect()} == {0: [ring(0.0), ring(1.0)], 1: [ring(2.0)]}
    f = f.first()
    assert (f["lon0"], f["span"], f["south"], f["north"], f["projection"]) == (3.75, 11.5, 41.5, 48.0, "laea") and f["parallel_1"] is None


def test_clusters_and_frames_over_the_seam(spark):
    p = parts(spark, [(178.0, -18.0, 1.5), (-180.0, -17.0, 1.0)])
    assert frame.main_parts(p).count() == 2
    f = frame.frame_of(p).first()
    assert f["span"] == 3.0 and f["lon0"] in (179.5, -180.5)
    wide = frame.frame_of(parts(spark, [(-30.0, 40.0, 20.0), (60.0, 40.0, 10.0)])).first()
    assert wide["projection"] == "albers" and wide["parallel_1"] < wide["parallel_2"]
    assert frame.frame_of(parts(spark, [(-170.0, 0.0, 20.0), (-60.0, 0.0, 5.0), (60.0, 10.0, 5.0)])).first()["projection"] == "equal_earth"


def area(shape):
    return float(overlay.areas([[shape]])[0])


def test_seam_keeps_areas_and_ranges():
    box = lambda w, e, s, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    got = seam.split_polygon([box(170, -170, 0, 10)], 0.0)
    assert len(got) == 2 and abs(area(got) - 200) < 1e-6 and all(abs(x) <= 180 + 1e-9 for part in got for r in part for x, _ in r)
    holed = seam.split_polygon([box(150, -150, 0, 20), box(160, 165, 5, 10), box(178, -178, 5, 10), box(-170, -165, 5, 10)], 0.0)
    assert len(holed) == 2 and sorted(len(p) for p in holed) == [2, 2] and abs(area(holed) - (60 * 20 - 25 - 20 - 25)) < 1e-6
    same = [[1.5, 2.25], [3.0, 2.0], [2.0, 4.0], [1.5, 2.25]]
    assert seam.split_polygon([same], 0.0) == [[same]]
    assert seam.split_polygon([[[170.0, 0.0]]], 0.0) == [] and seam.split_polygon([], 0.0) == []
    cap = [[lon, 70.0] for lon in range(-180, 180, 30)]
    polar = seam.split_polygon([cap], 0.0)
    assert abs(area(polar) - 360 * 20) < 1e-6 and max(y for part in polar for r in part for _, y in r) == 90.0
    south = seam.split_polygon([[[lon, -70.0] for lon in range(-180, 180, 30)]], 40.0)
    assert abs(area(south) - 360 * 20) < 1e-6 and min(y for part in south for r in part for _, y in r) == -90.0


def test_shared_vertices_unwrap_alike():
    v = 179.123456789
    a = seam.unwrapped(np.array([[-179.9, 0.0], [v, 1.0]]), 37.3)
    b = seam.unwrapped(np.array([[178.0, 5.0], [v, 1.0]]), 37.3)
    assert a[1, 0] == b[1, 0]


def test_lines_and_features(spark):
    assert seam.split_line([[170.0, 0.0], [-170.0, 10.0]], 0.0) == [[[170.0, 0.0], [180.0, 5.0]], [[-180.0, 5.0], [-170.0, 10.0]]]
    assert seam.split_line([[-170.0, 0.0], [170.0, 10.0], [160.0, 10.0]], 0.0)[1] == [[180.0, 5.0], [170.0, 10.0], [160.0, 10.0]]
    assert seam.split_line([[1.0, 1.0], [2.0, 2.0]], 0.0) == [[[1.0, 1.0], [2.0, 2.0]]] and seam.split_line([[1.0, 1.0]], 0.0) == []
    df = spark.createDataFrame([(1, [[[[170.0, 0.0], [-170.0, 0.0], [-170.0, 5.0], [170.0, 5.0]]]]), (2, None), (3, [])], "id int, geometry array<array<array<array<double>>>>")
    assert {r["id"]: r["geometry"] and len(r["geometry"]) for r in seam.split_at_seam(df, 0.0).collect()} == {1: 2, 2: None, 3: []}
    lines = spark.createDataFrame([(1, [[170.0, 0.0], [-170.0, 10.0]]), (2, None)], "id int, points array<array<double>>")
    assert seam.split_lines_at_seam(lines, 0.0).count() == 2
