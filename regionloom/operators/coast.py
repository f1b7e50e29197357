"""Outlines split into coast and borders on land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import points_in_polygons


def outline_runs(lines: DataFrame, neighbours: DataFrame, delta: float, size: float) -> DataFrame:
    """(line, run, kind, points): outline lines (line, pos, x, y, interior_left) cut where what lies outside changes.

    A segment is 'external' if the point at distance `delta` outward from its middle lies in a neighbour (id, box, edges), else
    'coast'; consecutive segments of one kind are a run. Segments without length don't count. `size`: the grid's finest cell.
    """
    along = W.partitionBy("line").orderBy("pos")
    s = lines.select("line", "pos", "interior_left", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(along).alias("bx"), F.lead("y").over(along).alias("by"))
    s = s.where("bx IS NOT NULL AND (ax <> bx OR ay <> by)")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    out = F.when(F.col("interior_left"), 1.0).otherwise(-1.0) * delta / F.hypot(dx, dy)
    probe = s.select(F.struct("line", "pos").alias("pid"), ((F.col("ax") + F.col("bx")) / 2 + out * dy).alias("x"), ((F.col("ay") + F.col("by")) / 2 - out * dx).alias("y"))
    land = points_in_polygons(probe, neighbours, size).select("pid.line", "pid.pos").distinct().withColumn("land", F.lit(True))
    kinds = s.join(land, ["line", "pos"], "left").withColumn("kind", F.when(F.col("land"), "external").otherwise("coast"))
    new = F.coalesce((F.col("kind") != F.lag("kind").over(along)).cast("int"), F.lit(1))
    runs = kinds.withColumn("new", new).withColumn("run", F.sum("new").over(along))
    ends = F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("a"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("b"))))
    g = runs.groupBy("line", "run").agg(F.min("kind").alias("kind"), ends.alias("s"))
    return g.select("line", F.col("run").cast("int").alias("run"), "kind", F.concat(F.array(F.col("s")[0]["a"]), F.transform("s", lambda e: e["b"])).alias("points"))
