"""Data units: regions grouped for statistics, their report, tags and dissolved outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import not_blank


def unit_rows(table: DataFrame, region: str = "map_id", unit: str = "data_unit_id", name: str = "data_unit_name", pos: str = "pos") -> DataFrame:
    """(region, unit, name, pos); rows without region or unit go."""
    name_column = not_blank(F.col(name)) if name in table.columns else F.lit(None).cast("string")
    rows = table.select(not_blank(F.col(region)).alias("region"), not_blank(F.col(unit)).alias("unit"), name_column.alias("name"), F.col(pos).alias("pos"))
    return rows.where("region is not null and unit is not null")


def assignments(rows: DataFrame) -> DataFrame:
    """(region, units): distinct units in table order."""
    first = rows.groupBy("region", "unit").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "unit")))
    return first.groupBy("region").agg(F.transform(ordered, lambda s: s["unit"]).alias("units"))


def unit_report(features: DataFrame, rows: DataFrame) -> DataFrame:
    """(finding, id): unknown regions, regions in several units, regions in none."""
    ids, units = features.select("id").distinct(), rows.select(F.col("region").alias("id"), "unit").distinct()
    unknown = units.join(ids, "id", "left_anti").select("id").distinct()
    several = units.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(ids, "id", "left_semi").select("id")
    none = ids.join(units, "id", "left_anti")
    out = unknown.select(F.lit("unknown").alias("finding"), "id")
    return out.unionByName(several.select(F.lit("overlapping").alias("finding"), "id")).unionByName(none.select(F.lit("unassigned").alias("finding"), "id"))


def split_units(edges: DataFrame, members: DataFrame, component) -> DataFrame:
    """Units whose members do not hang together: (unit, parts).

    edges: (a, b) of regions with a shared border; members: (region, unit), both ids long;
    component: a function from edges (u, v) to (node, component).
    """
    inside = (
        edges.join(members.select(F.col("region").alias("a"), F.col("unit")), "a")
        .join(members.select(F.col("region").alias("b"), F.col("unit").alias("unit_b")), "b")
        .where("unit = unit_b")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    found = component(inside)
    rooted = members.join(found.select(F.col("node").alias("region"), "component"), "region", "left")
    parts = rooted.groupBy("unit").agg(F.countDistinct(F.coalesce("component", "region")).alias("parts"))
    return parts.where("parts > 1")


def tag_units(features: DataFrame, rows: DataFrame) -> DataFrame:
    """`features` plus units (empty for a region in none)."""
    tags = assignments(rows).withColumnRenamed("region", "id")
    empty = F.array().cast("array<string>")
    return features.join(tags, "id", "left").withColumn("units", F.coalesce("units", empty))


def dissolve(features: DataFrame, rows: DataFrame) -> DataFrame:
    """Regions merged by their first unit; others stay.

    features: (id, name, class, parent, parent_name, country, geometry array). A unit's name is the
    last one in the table (else its id), its class that of the first member by id; parent, parent_name
    and country stay only if all members agree, nulls included; geometries are put together.
    """
    first = W.partitionBy("region").orderBy("pos")
    unit_of = rows.withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("region").alias("id"), "unit")
    names = rows.where("name is not null").groupBy("unit").agg(F.max_by("name", "pos").alias("unit_name"))
    tagged = features.join(unit_of, "id", "left")

    def agreed(c: str):
        same = F.min(F.coalesce(c, F.lit("\x00"))) == F.max(F.coalesce(c, F.lit("\x00")))
        return F.when(same, F.min(c)).alias(c)

    parts = F.array_sort(F.collect_list(F.struct("id", "geometry")))
    merged = (
        tagged.where("unit is not null")
        .groupBy("unit")
        .agg(F.min_by("class", "id").alias("class"), agreed("parent"), agreed("parent_name"), agreed("country"),
             F.flatten(F.transform(parts, lambda p: p["geometry"])).alias("geometry"))
        .join(names, "unit", "left")
        .select(F.col("unit").alias("id"), F.coalesce("unit_name", "unit").alias("name"), "class", "parent", "parent_name", "country", "geometry")
    )
    return merged.unionByName(tagged.where("unit is null").select(*merged.columns))
