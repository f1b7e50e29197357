"""What a map is framed on: the main cluster of a layer's parts, features cut down to it, extent and projection.

Parts: (part, feature, x0, y0, x1, y1), part a distinct long. Only one row a cluster reaches a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, spatial
from .rings import centre_longitude, covering_arc

GAP_KM = 500.0


def part_clusters(parts: DataFrame, gap_km: float = GAP_KM) -> DataFrame:
    """(part, component): parts at most gap_km apart belong together, by the smallest of them; lone parts to themselves."""
    boxes = parts.select(F.col("part").alias("id"), *spatial.BOX)
    found = graph.components(spatial.cluster_edges(boxes, gap_km))
    joined = boxes.select(F.col("id").alias("part")).join(found.withColumnRenamed("node", "part"), "part", "left")
    return graph.cut(joined.select("part", F.coalesce("component", "part").alias("component")))


def main_parts(parts: DataFrame, gap_km: float = GAP_KM) -> DataFrame:
    """The parts of the heaviest cluster: box areas times |cos latitude|, of equal ones the first."""
    clusters = part_clusters(parts, gap_km)
    middle = F.radians((F.col("y0") + F.col("y1")) / 2)
    weight = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * F.abs(F.cos(middle))).alias("weight")
    heavy = parts.join(clusters, "part").groupBy("component").agg(weight)
    best = heavy.agg(F.max_by("component", F.struct("weight", -F.col("component"))).alias("component"))
    return parts.join(clusters.join(F.broadcast(best), "component").select("part"), "part", "left_semi")  # one row


def restricted(features: DataFrame, kept: DataFrame) -> DataFrame:
    """Features (feature, ..., geometry) with only the kept parts (feature, at: place in the geometry); those left with none go."""
    places = kept.groupBy("feature").agg(F.array_sort(F.collect_set("at")).alias("_at"))
    cut = features.join(places, "feature")
    return cut.withColumn("geometry", F.filter(F.transform("_at", lambda i: F.get("geometry", i)), lambda p: p.isNotNull())).drop("_at")


def frame_of(parts: DataFrame, is_box: bool = False) -> DataFrame:
    """One row: lon0, lat0, span, south, north, the projection that suits them, and standard parallels if it is a conic."""
    ends = parts.select(F.lit("").alias("k"), F.explode(F.array("x0", "x1")).alias("lon"))
    arc = centre_longitude(covering_arc(ends, "k", "lon"))
    bounds = parts.agg(F.min("y0").alias("south"), F.max("y1").alias("north"))
    f = arc.join(F.broadcast(bounds)).withColumn("lat0", (F.col("south") + F.col("north")) / 2).withColumnRenamed("length", "span").withColumnRenamed("centre", "lon0")
    sixth = (F.col("north") - F.col("south")) / 6
    low, high = F.col("south") + sixth, F.col("north") - sixth
    even = F.abs(low + high) < 1
    first = F.when(even, F.greatest(low, F.lit(1.0))).otherwise(low)
    second = F.when(even, F.greatest(high, first + 1)).otherwise(high)
    name = projection_of(F.col("span"), F.col("lat0"), is_box)
    conic = lambda c: F.when(F.col("projection") == "albers", c)
    return f.withColumn("projection", name).select("lon0", "lat0", "span", "south", "north", "projection", conic(first).alias("parallel_1"), conic(second).alias("parallel_2"))


def projection_of(span: Column, lat0: Column, is_box: bool = False) -> Column:
    """As `projection.choose_projection`, by column."""
    wide = (span >= 45) & F.abs(lat0).between(20, 70) & (not is_box)
    return F.when(span.isNull() | (span > 200), "equal_earth").when(wide, "albers").otherwise("laea")


def framed(features: DataFrame, parts: DataFrame, gap_km: float = GAP_KM) -> tuple[DataFrame, DataFrame]:
    """Features cut down to the main cluster, and the frame of it. `parts` also has `at`, the part's place in its feature's geometry."""
    kept = graph.cut(main_parts(parts, gap_km))
    return restricted(features, kept), frame_of(kept)
