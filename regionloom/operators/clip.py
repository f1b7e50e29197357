"""Clipping to boxes, cuts at the seam, outlines, and repair with rollback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial

Box = tuple[float, float, float, float]


def clip_ring(ring: list[tuple[float, float]], box: Box) -> list[tuple[float, float]]:
    """A ring cut to a box, one side after the other; closed, empty if nothing is left."""
    x0, y0, x1, y1 = box
    points = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    sides = ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1))
    for axis, at, sign in sides:
        out: list[tuple[float, float]] = []
        for a, b in zip(points, points[1:] + points[:1]):
            ina, inb = sign * (a[axis] - at) >= 0, sign * (b[axis] - at) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (at - a[axis]) / (b[axis] - a[axis])
                other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                out.append((at, other) if axis == 0 else (other, at))
        points = out
        if not points:
            return []
    distinct = [p for i, p in enumerate(points) if p != points[i - 1]]
    return [*distinct, distinct[0]] if len(distinct) >= 3 else []


def clip_polygons(features: DataFrame, box: Box) -> DataFrame:
    """(id, geometry) cut to a box; features wholly inside pass as they are, those outside go. A concave shape may
    leave several parts, without bridges along the frame.

    The two quick cases are column expressions on the features' boxes; only what crosses the frame
    reaches Python.
    """
    x0, y0, x1, y1 = box
    f = features.select("id", "geometry").withColumns(spatial.polygon_box("geometry"))
    inside = (F.col("x0") >= x0) & (F.col("x1") <= x1) & (F.col("y0") >= y0) & (F.col("y1") <= y1)
    meets = spatial.in_box(x0, y0, x1, y1)

    frame = F.lit([[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]).cast(spatial.POLYGON)
    crossing = f.where(meets & ~inside).withColumn("frame", frame)
    cut = crossing.select("id", spatial.intersection_shape("geometry", "frame").alias("geometry")).where(F.size("geometry") > 0)
    return f.where(inside).select("id", "geometry").unionByName(cut)


def clip_segments(segments: DataFrame, box: Box) -> DataFrame:
    """Segments (ax, ay, bx, by) cut to a box by their entry and exit parameters."""
    x0, y0, x1, y1 = map(float, box)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    safe = lambda d: F.when(d != 0, d)
    ix, ox, okx = (
        F.when(dx == 0, 0.0).otherwise(F.least((F.lit(x0) - F.col("ax")) / safe(dx), (F.lit(x1) - F.col("ax")) / safe(dx))),
        F.when(dx == 0, 1.0).otherwise(F.greatest((F.lit(x0) - F.col("ax")) / safe(dx), (F.lit(x1) - F.col("ax")) / safe(dx))),
        (dx != 0) | F.col("ax").between(x0, x1),
    )
    iy, oy, oky = (
        F.when(dy == 0, 0.0).otherwise(F.least((F.lit(y0) - F.col("ay")) / safe(dy), (F.lit(y1) - F.col("ay")) / safe(dy))),
        F.when(dy == 0, 1.0).otherwise(F.greatest((F.lit(y0) - F.col("ay")) / safe(dy), (F.lit(y1) - F.col("ay")) / safe(dy))),
        (dy != 0) | F.col("ay").between(y0, y1),
    )
    s = segments.withColumn("_i", F.greatest(ix, iy, F.lit(0.0))).withColumn("_o", F.least(ox, oy, F.lit(1.0))).where(okx & oky & (F.col("_i") <= F.col("_o")))
    at = lambda a, d, t: F.col(a) + d * F.col(t)
    return s.withColumns({"ax": at("ax", dx, "_i"), "ay": at("ay", dy, "_i"), "bx": at("ax", dx, "_o"), "by": at("ay", dy, "_o")}).drop("_i", "_o")


def box_outline(west: Column | float, south: Column | float, east: Column | float, north: Column | float, steps: int = 32) -> Column:
    """A box's outline with `steps` points a side, closed, as an array of (x, y); a box whose east is west of its west goes over the seam."""
    w, s, e, n = (v if isinstance(v, Column) else F.lit(float(v)) for v in (west, south, east, north))
    e = F.when(e < w, e + 360.0).otherwise(e)
    t = lambda i: F.pmod(i, F.lit(steps)) / F.lit(float(steps))
    side = lambda i: F.floor(i / F.lit(steps)) % 4
    x = lambda i: F.when(side(i) == 0, w + t(i) * (e - w)).when(side(i) == 1, e).when(side(i) == 2, e + t(i) * (w - e)).otherwise(w)
    y = lambda i: F.when(side(i) == 0, s).when(side(i) == 1, s + t(i) * (n - s)).when(side(i) == 2, n).otherwise(n + t(i) * (s - n))
    return F.transform(F.sequence(F.lit(0), F.lit(4 * steps)), lambda i: F.struct(x(i).alias("x"), y(i).alias("y")))


def land_grid(polygons: DataFrame, width: int, height: int, cell: float = 6.0) -> DataFrame:
    """(map, row, col, land): is a cell's centre inside one of the map's polygons (map, id, box, edges)?

    A polygon looks only at the cells whose centres its own box holds.
    """
    rows, cols = int(-(-height // cell)), int(-(-width // cell))
    grid = polygons.select("map").distinct().select("map", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))

    def within(low: str, high: str, most: int) -> Column:
        a = F.greatest(F.lit(0.0), F.ceil(F.col(low) / cell - 0.5)).cast("int")
        b = F.least(F.lit(most - 1.0), F.floor(F.col(high) / cell - 0.5)).cast("int")
        return F.explode(F.when(a <= b, F.sequence(a, b)))

    boxed = polygons.withColumn("row", within("y0", "y1", rows)).withColumn("col", within("x0", "x1", cols))
    centre = boxed.withColumn("x", (F.col("col") + 0.5) * cell).withColumn("y", (F.col("row") + 0.5) * cell)
    hits = centre.where(spatial.point_in_rings(F.col("x"), F.col("y"), "edges")).select("map", "row", "col").distinct()
    return grid.join(hits.withColumn("land", F.lit(True)), ["map", "row", "col"], "left").withColumn("land", F.coalesce("land", F.lit(False)))
