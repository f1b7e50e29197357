"""Invalid parts are rebuilt in batches, and segments walk without comparing the cells of a segment with each other."""

import math
import random

from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from regionloom.operators import overlay, snap, spatial

SCHEMA = "feature int, part int, ring int, pos int, x double, y double"


def rows(shapes):
    return [(f, p, r, i, float(x), float(y)) for f, parts in shapes.items() for p, rings in enumerate(parts) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]


def made():
    """Squares, bow ties, rings there and back, holes over the edge, and features that have several of them."""
    def at(k, *points):
        return [(10 * k + x, y) for x, y in points]

    square, bow, line = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), ((0, 0), (1, 1), (1, 0), (0, 1), (0, 0)), ((0, 0), (1, 0), (0, 0))
    outer, hole = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ((3, 1), (5, 1), (5, 2), (3, 2), (3, 1))
    up = lambda ring, y: tuple((a, b + y) for a, b in ring)
    kinds = [[[square]], [[bow]], [[line]], [[outer, hole]], [[bow], [up(square, 5)], [up(outer, 10), up(hole, 10)], [up(line, 20)], [up(bow, 25)]]]
    return {k: [[at(k, *ring) for ring in part] for part in kinds[k % 5]] for k in range(60)}


def test_rebuilt_parts_take_no_group_of_their_own(spark, monkeypatch):
    calls = []
    plain = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a, **k: calls.append(a) or plain(self, *a, **k))
    shapes = made()
    out, problems = snap.rebuilt(spark.createDataFrame(rows(shapes), SCHEMA))
    bad = {(r["feature"], r["part"]) for r in problems.collect()}
    want = {}
    for f, parts in shapes.items():
        want |= {(f, p): part for p, part in enumerate(parts) if (f, p) not in bad}
        new = [n for p, part in enumerate(parts) if (f, p) in bad for n in overlay.unions([[[part]]])[0]]
        want |= {(f, len(parts) + i): part for i, part in enumerate(new)}
    assert sorted(map(tuple, out.collect())) == sorted((f, p, r, i, x, y) for (f, p), part in want.items() for r, ring in enumerate(part) for i, (x, y) in enumerate(ring))
    assert [(c.name, c.dataType) for c in out.schema] == [(c.name, c.dataType) for c in spark.createDataFrame([], SCHEMA).schema]
    assert not calls


def test_parts_without_area_go(spark):
    df = spark.createDataFrame(rows({k: [[[(k, 0), (k + 1, 0), (k, 0)]]] for k in range(40)}), SCHEMA)
    out, problems = snap.rebuilt(df)
    assert out.count() == 0 and problems.count() == 40


def test_a_cell_is_walked_once_a_segment(spark):
    rng = random.Random(11)
    segments = []
    for k in range(200):
        x, y, n, turn = rng.choice([0.0, 1.0, rng.uniform(-9, 9)]), rng.choice([0.0, rng.uniform(-9, 9)]), 10 ** rng.uniform(-5, 1), rng.randrange(16) * math.pi / 8
        segments.append((k, x, y, x + n * math.cos(turn), y + n * math.sin(turn)))
    tolerance = 1e-3
    walked = spatial._walked(spark.createDataFrame(segments, "sid long, ax double, ay double, bx double, by double"), 4 * tolerance, tolerance)
    want = set()
    for s, ax, ay, bx, by in segments:
        length = max(abs(bx - ax), abs(by - ay))
        level = max(0, math.ceil(math.log2(max(length / spatial.PIECES, 4 * tolerance) / (4 * tolerance)) - 1e-9))
        cell = 4 * tolerance * 2.0**level
        n = max(1, math.ceil(length / cell))
        at = lambda a, b, i: a + i / n * (b - a)
        span = lambda a, b, i: range(math.floor((min(at(a, b, i), at(a, b, i + 1)) - tolerance) / cell), math.floor((max(at(a, b, i), at(a, b, i + 1)) + tolerance) / cell) + 1)
        want |= {(s, level, x, y) for i in range(n) for x in span(ax, bx, i) for y in span(ay, by, i)}
    assert sorted(map(tuple, walked.select("sid", "level", "cx", "cy").collect())) == sorted(want)
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and walked.agg(F.count(F.lit(1))).first()[0] == len(want)
