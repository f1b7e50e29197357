"""Shapes out of shared arcs: rings cut at junctions, arcs simplified once, stitched back together.

A border between two features is one arc, whoever walks it, so both get the same simplified line.
Vertices are ring rows (feature, part, ring, pos, x, y), ring 0 the outer one; arcs are the rows of
`rings.cut_arcs`. Work is per ring or per arc; features meet only in joins on the arc.

Rings of fewer than three distinct points fall out; a feature of which nothing is left keeps its
largest part as it was. Repeated vertices count once. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rings
from .graph import cut

POINTS = "array<struct<x:double,y:double>>"
PART = ("feature", "part")


def ring_arcs(vertices: DataFrame) -> DataFrame:
    """(feature, part, ring, arc, key, reversed): each ring's arcs in its order; the same border has the same key."""
    opened = cut(rings.open_rings(rings.clean_rings(vertices)))
    return cut(rings.cut_arcs(opened, rings.junctions(opened)))


def simplified(arcs: DataFrame, epsilon: float) -> DataFrame:
    """(key, line): each distinct arc once, without the vertices whose triangles are at most epsilon; ends stay."""
    distinct = arcs.select("key").distinct()
    if epsilon <= 0:
        return distinct.select("key", F.col("key").alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [rings.simplify(np.array([(p["x"], p["y"]) for p in key], float), epsilon) for key in b["key"]]
            yield b.assign(line=[[{"x": x, "y": y} for x, y in line.tolist()] for line in lines])

    return distinct.mapInPandas(run, f"key {POINTS}, line {POINTS}")


def stitched(arcs: DataFrame, lines: DataFrame) -> DataFrame:
    """(feature, part, ring, points, area): rings closed again out of their arcs; area is signed, those without any are gone."""
    walked = F.when(F.col("reversed"), F.reverse("line")).otherwise(F.col("line"))
    used = arcs.join(lines, "key").select(*rings.RING, F.struct("arc", F.slice(walked, F.lit(1), F.size("line") - 1).alias("body")).alias("a"))
    body = F.flatten(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["body"]))  # the arcs of one ring
    ring = used.groupBy(*rings.RING).agg(body.alias("body")).withColumn("points", F.concat("body", F.slice("body", 1, 1)))
    return ring.withColumn("area", rings.ring_area(F.col("points"))).where((F.size("body") >= 3) & (F.col("area") != 0)).select(*rings.RING, "points", "area")


def parts_of(ring_rows: DataFrame) -> DataFrame:
    """(feature, part, rings, area): parts that still have their outer ring, with the holes that are left."""
    holes = F.transform(F.array_sort(F.collect_list(F.when(F.col("ring") > 0, F.struct("ring", "points")))), lambda r: r["points"])
    outer = F.max(F.when(F.col("ring") == 0, F.struct("points"))).alias("outer")  # one row a part
    area = F.sum(F.when(F.col("ring") == 0, F.abs("area")).otherwise(-F.abs("area")))
    part = ring_rows.groupBy(*PART).agg(outer, holes.alias("holes"), area.alias("area")).where("outer IS NOT NULL")
    return part.select(*PART, F.concat(F.array("outer.points"), "holes").alias("rings"), "area")


def original_parts(vertices: DataFrame) -> DataFrame:
    """Parts as they were given, closed."""
    point = F.struct("pos", F.struct("x", "y").alias("p"))
    points = F.transform(F.array_sort(F.collect_list(point)), lambda v: v["p"])
    ring = vertices.groupBy(*rings.RING).agg(points.alias("points"))
    return parts_of(ring.withColumn("area", rings.ring_area(F.col("points"))))


def finish(vertices: DataFrame, arcs: DataFrame, lines: DataFrame, min_area: float = 0.0, keep_largest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Features (feature, geometry) and the borders of what is kept (key, line, a, b, interior_left).

    Parts under min_area go, but for the largest of features for which `keep_largest` (of their id; default: all) holds; the
    first of equal ones is the largest. A feature whose parts have all collapsed gets its largest original part.
    Borders: `b` is null on an outline, and `interior_left` says on which side of the line `a` lies; an arc
    that one feature uses twice is a cut inside of it, not a border.
    """
    ring_rows = cut(stitched(arcs, lines))
    parts = cut(parts_of(ring_rows))
    keep = F.lit(True) if keep_largest is None else keep_largest
    best = parts.groupBy("feature").agg(F.max_by("part", F.struct(F.col("area"), -F.col("part"))).alias("best"))
    kept = cut(parts.join(best, "feature").where((F.col("area") >= min_area) | (keep & (F.col("part") == F.col("best")))))
    gone = original_parts(vertices).join(parts.select("feature").distinct(), "feature", "left_anti")
    first = gone.groupBy("feature").agg(F.max_by(F.struct("part", "rings"), F.struct(F.col("area"), -F.col("part"))).alias("p")).select("feature", "p.part", "p.rings")
    all_parts = kept.select("feature", "part", "rings").unionByName(first)
    shape = F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda p: p["rings"])
    empty = F.array().cast(f"array<array<{POINTS}>>")
    names = vertices.select("feature").distinct()
    features = names.join(all_parts.groupBy("feature").agg(shape.alias("geometry")), "feature", "left").withColumn("geometry", F.coalesce("geometry", empty))

    inside = (F.col("area") > 0) == (F.col("ring") == 0)  # of the ring as it is walked: left
    sides = ring_rows.join(kept.select(*PART), [*PART]).select(*rings.RING, inside.alias("inside"))
    uses = arcs.join(sides, [*rings.RING]).select("key", "feature", (F.col("inside") != F.col("reversed")).alias("left"))
    users = uses.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("feature").alias("a"), F.max("feature").alias("last"), F.min_by("left", "feature").alias("left"), F.array_sort(F.collect_set("feature")).alias("users"))
    alone = F.col("a") == F.col("last")
    borders = users.where(~alone | (F.col("n") == 1)).join(lines, "key").where(F.size("line") >= 2)
    return features, borders.select("key", "line", "a", F.get("users", F.lit(1)).alias("b"), F.when(alone, F.col("left")).alias("interior_left"))


def simplify_shared(vertices: DataFrame, epsilon: float, min_area: float = 0.0, keep_largest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Features simplified together, and their borders: cut at junctions, each arc simplified once, stitched back."""
    arcs = ring_arcs(vertices)
    return finish(vertices, arcs, cut(simplified(arcs, epsilon)), min_area, keep_largest)


def line_length(line: str) -> Column:
    pairs = F.zip_with(line, F.slice(line, 2, F.size(line)), lambda a, b: F.when(b.isNotNull(), F.hypot(b["x"] - a["x"], b["y"] - a["y"])).otherwise(0.0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def shape_area(geometry: str) -> Column:
    """Area of a geometry of parts of rings of points."""
    part = lambda p: F.aggregate(F.transform(p, lambda r: F.abs(rings.ring_area(r))), F.lit(0.0), lambda s, x: s - x) + 2 * F.coalesce(F.abs(rings.ring_area(F.get(p, F.lit(0)))), F.lit(0.0))
    return F.aggregate(F.col(geometry), F.lit(0.0), lambda s, p: s + part(p))
