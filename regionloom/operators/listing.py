"""Listings of a catalogue: data sets, their regions and features, and a report's totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .naming import area_of_category

#: What a data set tells of its origin.
PROVENANCE = ("credit", "licence", "licence_url", "share_alike", "release", "boundary_year")


def datasets(catalogue: DataFrame, regions: DataFrame) -> DataFrame:
    """The catalogue (dataset, per_region boolean, ...) with the number of regions (dataset, code, provenance columns), and the
    origin of the first one; with one file a region origins differ, so none is told. Data sets without regions have 0.
    """
    known = [c for c in PROVENANCE if c in regions.columns]
    first = F.min_by(F.struct(*known), "code").alias("_p")
    found = regions.groupBy("dataset").agg(F.count(F.lit(1)).alias("regions"), first)
    out = catalogue.join(found, "dataset", "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
    return out.select("*", *[F.when(~F.col("per_region"), F.col(f"_p.{c}")).alias(c) for c in known]).drop("_p")


def region_kinds(regions: DataFrame) -> DataFrame:
    """Regions (code, column, ...) with their kind: the world, a file of their own, a continent, or a region of a file."""
    kind = F.when(F.col("column").isNull(), F.when(F.col("code") == "world", "world").otherwise("file")).when(F.col("column") == "CONTINENT", "continent").otherwise("region")
    return regions.withColumn("kind", kind)


def features(layer: DataFrame, region: Column, languages: list[str]) -> DataFrame:
    """A region's features without their geometry, names only in the given languages: the scan reads just these columns."""
    names = F.map_filter("names", lambda lang, name: lang.isin(*languages) & name.isNotNull()) if languages else F.create_map().cast("map<string,string>")
    shown = [c for c in ("parent", "parent_name", "country", "units", "wikidata") if c in layer.columns]
    return layer.where(region).select(F.col("id").alias("code"), "name", names.alias("names"), *shown)


def best_areas(categories: DataFrame) -> DataFrame:
    """(file, area): of the areas that a file's categories (file, category, depth) name the one that isn't of a group of places,
    then the longest, the deepest, and the last by area and category.
    """
    named = F.trim(F.split(area_of_category(F.col("category")), r"(?i)\s+by\s+User:")[0])
    rows = categories.withColumn("area", named).where("area <> ''")
    group = F.col("area").rlike(r"(?i)^(?:countries|capitals|places|locations)(?:\s+of\b|$)")
    return rows.groupBy("file").agg(F.max_by("area", F.struct(~group, F.length("area"), "depth", "area", "category")).alias("area"))


def totals(files: DataFrame) -> DataFrame:
    """One row on files (usages, hash, issue boolean): their number, those in use, all usages, issues, and groups of equal hashes."""
    hashes = files.where("hash IS NOT NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups"))  # one row
    n = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("usages") > 0).alias("used"), F.coalesce(F.sum("usages"), F.lit(0)).alias("usages"), F.count_if("issue").alias("issues"))
    return n.join(F.broadcast(hashes)).withColumnRenamed("groups", "duplicate_groups")
