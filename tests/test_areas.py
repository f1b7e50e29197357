"""Areas of polygons against sampling-free values and the JVM's shoelace."""

import math
import random

import numpy as np
from regionloom.operators import overlay as O
from regionloom.operators import spatial as S


def ring(n, x, y, r):
    return [[x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)] for k in range(n)]


def box(a, b, c, d):
    return [[[[a, b], [c, b], [c, d], [a, d], [a, b]]]]


def test_kernel_values():
    two = lambda a, b, union=False: float(O.areas([[a, b]], union)[0])
    assert two(box(0, 0, 2, 2), box(1, 1, 3, 3)) == 1.0 and two(box(0, 0, 1, 1), box(2, 0, 3, 1)) == 0.0
    tri = [[[[0, 0], [4, 0], [0, 4], [0, 0]]]]
    assert abs(two(tri, box(0, 0, 2, 2)) - 4.0) < 1e-12 and abs(two(tri, box(1, 1, 5, 5)) - 2.0) < 1e-12
    holed = [[*box(0, 0, 4, 4)[0], *box(1, 1, 3, 3)[0]]]
    assert abs(two(holed, tri, True) - (16 - 4 + 2)) < 1e-12
    assert two(None, tri) == 0.0 and two(None, tri, True) == 8.0 and two([[[[0, float("nan")], [1, 1], [2, 0]]]], tri, True) == 8.0
    assert O.areas([]).tolist() == [] and O.unions([[], [None]]) == [[], []]


def test_kernel_against_inclusion_and_exclusion():
    rng = random.Random(2)
    rows = [[[[ring(rng.randint(3, 40), rng.random(), rng.random(), 0.2 + rng.random())]] for _ in range(2)] for _ in range(60)]
    both, any_ = O.areas(rows), O.areas(rows, True)
    one, two = O.areas([[r[0]] for r in rows]), O.areas([[r[1]] for r in rows])
    assert np.abs(both + any_ - one - two).max() < 1e-9
    shapes = O.unions(rows)
    assert np.abs(O.areas([[u] for u in shapes]) - any_).max() < 1e-9
    assert np.abs(O.areas([[u] for u in O.intersections(rows)]) - both).max() < 1e-9
    assert all(r[0] == r[-1] and len({tuple(p) for p in r}) == len(r) - 1 for u in shapes for part in u for r in part)


def test_kernel_of_many_vertices_takes_no_square_of_them():
    import time

    began = time.time()
    a, b = [[ring(4000, 0, 0, 1.0)]], [[ring(4000, 0.5, 0.2, 1.0)]]
    d = math.hypot(0.5, 0.2)
    lens = 2 * math.acos(d / 2) - d / 2 * math.sqrt(4 - d * d)
    assert abs(O.areas([[a, b]])[0] - lens) < 1e-5 and time.time() - began < 2
    O.areas([[[[ring(100_000, 0, 0, 1.0)]], [[ring(100_000, 0.1, 0, 1.0)]]]])
    assert time.time() - began < 30


def test_unions_of_grids_with_holes():
    cells = {(i, j) for i in range(9) for j in range(9)} - {(1, 1), (4, 4), (4, 5), (7, 2), (2, 3)}
    got = O.unions([[box(i, j, i + 1, j + 1) for i, j in sorted(cells)]])[0]
    assert len(got) == 1 and len(got[0]) == 5 and float(O.areas([[got]])[0]) == len(cells)
    bow = O.unions([[[[[[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]]]]])[0]
    assert len(bow) == 2 and all(len(p[0]) == 4 for p in bow)  # two triangles
    assert O.unions([[box(0, 0, 1, 1)] * 2])[0] == box(0, 0, 1, 1)
    assert [len(u) for u in O.unions([[box(3 * k, 0, 3 * k + 1, 1) for k in range(200)], [box(0, 0, 1, 1), box(1, 1, 2, 2)]])] == [200, 2]


def test_areas_in_the_jvm(spark):
    rows = [(0, [[ring(7, 1, 2, 3.0)]]), (1, [[ring(9, 0, 0, 4.0), ring(5, 0, 0, 1.0)], [ring(3, 20, 0, 1.0)]]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, g array<array<array<array<double>>>>")
    for r in df.withColumn("a", S.polygon_area("g")).collect():
        want = O.areas([[rows[r["id"]][1]]])[0]
        assert abs(r["a"] - want) < 1e-9
