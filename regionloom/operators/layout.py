"""Grids, legend slots, inset places and labels."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summed_area(grid: DataFrame, key: list[str], value: str) -> DataFrame:
    """Two-dimensional prefix sums of a grid (key, row, col, value): adds `total`."""
    across = W.partitionBy(*key, "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*key, "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    return grid.withColumn("_s", F.sum(value).over(across)).withColumn("total", F.sum("_s").over(down)).drop("_s")


def land_count(grid: DataFrame, key: list[str], row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Land cells of each grid in a rectangle (inclusive)."""
    inside = F.col("row").between(row0, row1) & F.col("col").between(col0, col1)
    return grid.groupBy(*key).agg(F.count_if(inside & F.col("land")).alias("n"))


def place_box(candidates: DataFrame, taken: DataFrame, gap: float = 4.0) -> DataFrame:
    """For each map the candidate (map, pos, x0, y0, x1, y1, land) that covers least land, the first of equals,
    among those at least `gap` from every taken box (map, x0, y0, x1, y1).
    """
    t = taken.select("map", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    near = (F.col("x0") < F.col("tx1") + gap) & (F.col("tx0") < F.col("x1") + gap) & (F.col("y0") < F.col("ty1") + gap) & (F.col("ty0") < F.col("y1") + gap)
    c = candidates.alias("c")
    free = c.join(t.alias("t"), (F.col("c.map") == F.col("t.map")) & near, "left_anti")
    return free.groupBy("map").agg(F.min_by(F.struct("pos", "x0", "y0", "x1", "y1", "land"), F.struct("land", "pos")).alias("b")).select("map", "b.*")


def _distance(x: float, y: float, ring: list[tuple[float, float]]) -> float:
    """Signed distance to a ring: positive inside."""
    inside, best = False, float("inf")
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / n)) if n else 0.0
        best = min(best, ((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) ** 0.5)
    return best if inside else -best


def pole(ring: list[tuple[float, float]], precision: float) -> tuple[float, float, float]:
    """Pole of inaccessibility (x, y, distance): cells by the best distance they can still hold."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    w, h = max(xs) - min(xs), max(ys) - min(ys)
    size = min(w, h)
    cx, cy = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2
    best = (cx, cy, _distance(cx, cy, ring))
    if not size:
        return best
    half, n, heap = size / 2, 0, []

    def push(x: float, y: float, r: float) -> None:
        nonlocal best, n
        d = _distance(x, y, ring)
        if d > best[2]:
            best = (x, y, d)
        heapq.heappush(heap, (-(d + r * 2**0.5), n, x, y, r))
        n += 1

    x = min(xs)
    while x < max(xs):
        y = min(ys)
        while y < max(ys):
            push(x + half, y + half, half)
            y += size
        x += size
    while heap:
        reach, _, x, y, r = heapq.heappop(heap)
        if -reach - best[2] <= precision:
            break
        for dx in (-r / 2, r / 2):
            for dy in (-r / 2, r / 2):
                push(x + dx, y + dy, r / 2)
    return best


def poles(polygons: DataFrame, precision: float) -> DataFrame:
    """(id, x, y, distance) of polygons (id, ring): each on its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [pole([tuple(p) for p in r], precision) for r in b["ring"]]
            yield pd.DataFrame({"id": b["id"], "x": [f[0] for f in found], "y": [f[1] for f in found], "distance": [f[2] for f in found]})

    return polygons.select("id", "ring").mapInPandas(run, "id long, x double, y double, distance double")


def smoothed(points: DataFrame, key: str, order: str, value: str, passes: int = 2) -> DataFrame:
    """Three-point moving average with fixed ends, repeated."""
    w = W.partitionBy(key).orderBy(order)
    out = points
    for _ in range(passes):
        inner = F.lag(value).over(w).isNotNull() & F.lead(value).over(w).isNotNull()
        out = out.withColumn(value, F.when(inner, F.avg(value).over(w.rowsBetween(-1, 1))).otherwise(F.col(value)))
    return out


def path_lengths(points: DataFrame, key: str, order: str) -> DataFrame:
    """Running length along a path (key, order, x, y): adds `length`."""
    w = W.partitionBy(key).orderBy(order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("length", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")
