"""Unions of many polygons a group, as a tree of small unions.

A level joins the polygons of a group that lie in one cell, at most about `FAN` of them a task (a
crowded cell is dealt over several), on the next level cells are four times as wide, so neighbours
meet early and inner borders are gone before a group's parts come together. No level holds a group
whole but the last, which gets at most `FAN` polygons of each.

Equal polygons of a group are one. A task joins about `POINTS_A_TASK` points, so tasks become more, not larger.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlay, spatial
from .graph import cut

FAN = 48
POINTS_A_TASK = 50_000


def _joined(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each combination of `by`: the union of its polygons."""
    def unions(shapes: pd.Series) -> pd.Series:
        return pd.Series(overlay.unions([list(s) for s in shapes]), dtype=object)

    points = rows.agg(F.sum(F.size(F.flatten(F.flatten("geometry"))))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(points) // POINTS_A_TASK))
    one = rows.repartition(tasks, *by).groupBy(*by).agg(F.collect_list("geometry").alias("shapes"))  # about FAN polygons
    return one.select(*by, F.pandas_udf(unions, spatial.POLYGON)("shapes").alias("geometry"))


def union_by(features: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """(key, geometry): the union of each key's polygons. Rows without a key take no part; empty and null geometries add nothing."""
    f = features.select(F.col(key).alias("_key"), "geometry").where("_key IS NOT NULL")
    rows = cut(f.where(F.size("geometry") > 0).distinct().withColumns(spatial.polygon_box("geometry")))
    keys = f.select("_key").distinct()
    width = rows.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    width = 2.0 * width if width and width < float("inf") else 1.0
    while True:
        sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
        if not sizes.where(F.col("n") > fan).head(1):
            break
        w = F.lit(width)
        rows = rows.withColumns({"cx": F.floor((F.col("x0") + F.col("x1")) / 2 / w), "cy": F.floor((F.col("y0") + F.col("y1")) / 2 / w)})
        place = ["_key", "cx", "cy"]
        crowds = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("deals"))
        dealt = rows.join(crowds, place).withColumn("deal", F.pmod(F.xxhash64("geometry"), F.col("deals")))
        rows = cut(_joined(dealt, [*place, "deal"]).drop(*place[1:], "deal").withColumns(spatial.polygon_box("geometry")))
        width *= 4.0
    whole = _joined(rows.select("_key", "geometry"), ["_key"])
    none = F.array().cast(spatial.POLYGON)
    return keys.join(whole, "_key", "left").select(F.col("_key").alias(key), F.coalesce("geometry", none).alias("geometry"))


def grouped_references(features: DataFrame, code: Column, parent: Column, prefix: str = "") -> DataFrame:
    """(code, parent, geometry): features (pos, geometry, ...) grouped by code, the parent of the first one, geometries united.

    Features without a code go; code and parent get the prefix.
    """
    f = features.select("pos", code.alias("_code"), parent.alias("_parent"), "geometry").where("_code IS NOT NULL")
    named = lambda c: F.concat(F.lit(prefix), c)
    first = f.groupBy("_code").agg(F.min_by(F.struct("_parent"), "pos").alias("first"))  # a struct, for min_by passes nulls by
    united = union_by(f, "_code")
    return united.join(first, "_code").select(named(F.col("_code")).alias("code"), named(F.col("first._parent")).alias("parent"), "geometry")


def ring_counts(geometry: str) -> dict[str, Column]:
    """parts, holes and the length of all rings of a polygon column.

    Holes are pieces of the outside that a part encloses: rings that share a vertex are one piece, and a ring that shares one with
    the part's outer ring is none.
    """
    ring = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda t, i: t + F.hypot(r[i][0] - r[i - 1][0], r[i][1] - r[i - 1][1]))
    rings = F.flatten(F.col(geometry))
    opened = lambda part: F.flatten(F.transform(part, lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))))
    touches = F.aggregate(geometry, F.lit(0), lambda t, part: t + F.size(opened(part)) - F.size(F.array_distinct(opened(part))))
    return {"parts": F.size(geometry), "holes": F.size(rings) - F.size(geometry) - touches, "length": F.aggregate(rings, F.lit(0.0), lambda t, r: t + ring(r))}
