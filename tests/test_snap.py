"""Snapping and repair: order, rings apart, waves as the plain order, rollback; clipping of concave shapes."""

import random

from regionloom.operators import clip, rings, snap

SCHEMA = "feature long, part int, ring int, pos int, x double, y double"
LAYERED = "layer string, owner long, part int, ring int, pos int, x double, y double"


def square(x, y, w=1.0):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


def rows(features):
    return [(f, p, r, i, float(x), float(y)) for f, parts in features.items() for p, rs in enumerate(parts) for r, ring in enumerate(rs) for i, (x, y) in enumerate(ring)]


def plain_snap(features, tol):
    """Feature after feature, all earlier vertices and edges looked at."""
    seen, edges, out = [], [], {}

    def nearest(p):
        found = [((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, q) for q in seen]
        best = min(found, default=(9e9, None))
        if best[0] <= tol * tol:
            return best[1]
        found = []
        for a, b in edges:
            v = (b[0] - a[0], b[1] - a[1])
            n = v[0] ** 2 + v[1] ** 2
            t = max(0, min(1, ((p[0] - a[0]) * v[0] + (p[1] - a[1]) * v[1]) / n)) if n else 0
            f = b if t == 1 else (a[0] + t * v[0], a[1] + t * v[1])
            found.append(((p[0] - f[0]) ** 2 + (p[1] - f[1]) ** 2, f))
        best = min(found, default=(9e9, None))
        return best[1] if best[0] <= tol * tol else p

    for f in sorted(features):
        new = []
        for part in features[f]:
            for ring in part:
                r = [nearest(p) for p in ring[:-1]]
                new.append([*r, r[0]])
        out[f] = new
        for r in new:
            seen += r
            edges += list(zip(r, r[1:]))
    return out


def jittered(seed):
    rng = random.Random(seed)
    f = {}
    for k in range(36):
        j = lambda: rng.uniform(-0.004, 0.004)
        x, y = k % 6, k // 6
        ring = [(x + dx + j(), y + dy + j()) for dx, dy in ((0, 0), (0.5, 0), (1, 0), (1, 0.4), (1, 1), (0, 1))]
        f[k] = [[[*ring, ring[0]]]]
        if k % 5 == 0:
            f[k].append([square(x + 0.3 + j(), y + 0.3, 0.2), square(x + 0.35, y + 0.35, 0.05)])
    return f


def snapped(df, tol, most):
    out = {}
    for r in sorted(snap.snap_features(df, tol, most).collect(), key=lambda r: (r["owner"], r["part"], r["ring"], r["pos"])):
        out.setdefault(r["owner"], {}).setdefault((r["part"], r["ring"]), []).append((r["x"], r["y"]))
    return {f: list(v.values()) for f, v in out.items()}


def test_waves_give_what_the_order_gives(spark):
    f = jittered(3)
    df = spark.createDataFrame([("l", *r) for r in rows(f)], LAYERED)
    want = plain_snap(f, 0.01)
    for most in (10**6, 10):
        got = snapped(df, 0.01, most)
        assert got.keys() == want.keys()
        for k in want:
            for a, b in zip(got[k], want[k]):
                assert all(abs(p[0] - q[0]) < 1e-12 and abs(p[1] - q[1]) < 1e-12 for p, q in zip(a, b)) and len(a) == len(b)


def test_rings_are_apart(spark):
    """A vertex far from every edge stays, though it lies between the ends of two parts."""
    f = {0: [[square(0, 0)], [square(9, 0)]], 1: [[[(5, 0.005), (6, 4), (4, 4), (5, 0.005)]]]}
    got = snapped(spark.createDataFrame([("l", *r) for r in rows(f)], LAYERED), 0.01, 10**6)
    assert got[1][0][0] == (5.0, 0.005)
    assert snap.snap_features(spark.createDataFrame([], LAYERED), 0.1).count() == 0


def test_repair_fixes_bow_ties_and_closes_near_misses(spark):
    bow = [(0, 0), (1, 1), (1, 1), (1, 0), (0, 1), (0, 0)]
    df = spark.createDataFrame(rows({1: [[bow]], 2: [[square(20, 0)]], 3: [[square(21.00005, 0)]]}), SCHEMA)
    out, done = snap.repair(df, 1e-4)
    assert done == {"snapped_vertices": 2, "removed_points": 1, "fixed_polygons": 1, "snapping_reverted": False}
    assert rings.polygon_problem(rings.edges(out), 1.0).count() == 0
    assert out.where("feature = 1").select("part").distinct().count() == 2
    assert {r["x"] for r in out.where("feature = 3").collect()} == {21.0, 22.00005}
    assert snap._misses(out, 1e-4) == (0, 0)


def test_repair_prefers_existing_vertices_and_reverts_what_does_not_help(spark):
    df = spark.createDataFrame(rows({1: [[square(0, 0)]], 2: [[square(1.00003, 1.00002)]]}), SCHEMA)
    out, done = snap.repair(df, 1e-4)
    assert out.where("feature = 2 and x = 1.0 and y = 1.0").count() > 0 and done["snapped_vertices"] == 1
    clean, none = snap.repair(spark.createDataFrame(rows({1: [[square(0, 0)]]}), SCHEMA), 1e-4)
    assert clean.count() == 5 and none["snapped_vertices"] == 0 and not none["snapping_reverted"]


def test_validity(spark):
    cases = {
        1: [[square(0, 0)]], 2: [[[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]]],
        3: [[[(0, 0), (2, 0), (2, 2), (1, 2), (1, -1), (0, 2), (0, 0)]]],
        4: [[square(0, 0, 4), square(1, 1)]], 5: [[square(0, 0, 4), square(3, 1, 2)]], 6: [[[(0, 0), (1, 0), (0, 0)]]],
        7: [[[(0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2), (0, 0)]]],  # pinched
        8: [[[(0, 0), (2, 0), (2, 2), (1, 2), (1, 0), (1.5, 0), (0, 0)]]],  # spike
        9: [[[(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]],  # repeated vertex
    }
    found = rings.polygon_problem(rings.edges(spark.createDataFrame(rows(cases), SCHEMA)), 1.0)
    assert {r["feature"] for r in found.collect()} == {2, 3, 5, 6, 8}


def test_concave_shapes_leave_several_parts_of_a_frame(spark):
    comb = [(0, 0), (5, 0), (5, 3), (4, 3), (4, 1), (3, 1), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)]
    df = spark.createDataFrame([(1, [[[list(map(float, p)) for p in comb]]]), (2, [[[[9.0, 9.0], [9.5, 9.0], [9.0, 9.5]]]]), (3, None)], "id long, geometry array<array<array<array<double>>>>")
    got = {r["id"]: r["geometry"] for r in clip.clip_polygons(df, (-1.0, 2.0, 6.0, 8.0)).collect()}
    assert got.keys() == {1} and len(got[1]) == 3 and all(len(p[0]) == 5 for p in got[1])
