"""GeoJSON text as features: geometry in nested arrays, properties as a map of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_meaningful, language_column, language_map, meaningful, with_note

_FEATURE = "struct<type:string,id:string,properties:map<string,string>,geometry:string>"
_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"

#: Feature classes of capitals.
COUNTRY_CAPITALS = ("admin-0 capital", "admin-0 capital alt")
REGION_CAPITALS = ("admin-1 capital", "admin-1 region capital", "admin-0 region capital")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def records(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a feature: keeps the other columns, adds row, feature_id, properties, geometry (text).

    A collection, a single feature or a bare geometry; features without geometry go.
    """
    keep = [c for c in texts.columns if c != text]
    kind = F.get_json_object(text, "$.type")
    many = F.from_json(F.col(text), f"struct<features:array<{_FEATURE}>>")["features"]
    one = F.array(F.from_json(F.col(text), _FEATURE))
    bare = F.array(F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.create_map().cast("map<string,string>").alias("properties"), F.col(text).alias("geometry")))
    parts = F.when(kind == "FeatureCollection", many).when(kind == "Feature", one).otherwise(bare)
    rows = texts.select(*keep, F.posexplode(parts).alias("row", "f"))
    return rows.where(F.col("f.geometry").isNotNull()).select(*keep, "row", F.col("f.id").alias("feature_id"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


NESTED = 6  # collections within collections that are read


def _parts(geometry: Column, one: str, many: str, element: str, nested: int) -> Column:
    """Parts of a geometry text of type `one` or `many`, also out of collections, nested ones too; else none."""
    kind, coords = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    own = F.when(kind == one, F.array(F.from_json(coords, element))).when(kind == many, F.from_json(coords, f"array<{element}>"))
    if nested:
        inner = F.from_json(F.get_json_object(geometry, "$.geometries"), "array<string>")
        own = own.when(kind == "GeometryCollection", F.flatten(F.transform(inner, lambda g: _parts(g, one, many, element, nested - 1))))
    return own.otherwise(F.array().cast(f"array<{element}>"))


def polygons(geometry: Column) -> Column:
    """Polygon parts of a geometry text: polygons, multipolygons and collections of them; else none."""
    return _parts(geometry, "Polygon", "MultiPolygon", _POLYGON, NESTED)


def lines(geometry: Column) -> Column:
    """Line parts of a geometry text, out of collections too."""
    return _parts(geometry, "LineString", "MultiLineString", "array<array<double>>", NESTED)


def property_of(name: str) -> Column:
    """A property by its exact name, else by its name in any case."""
    in_any_case = F.map_values(F.map_filter("properties", lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.try_element_at("properties", F.lit(name)), F.get(in_any_case, 0))


def features(rows: DataFrame, ids: Sequence[str], name: str, filter_column: str | None = None, region: str | None = None, note: str | None = None,
             parent: str | None = None, parent_name: str | None = None, country: str | None = None, languages: Sequence[str] = (), pattern: str = "NAME_{lang}") -> DataFrame:
    """Layer features of `records`: the identifier is the first id property, the feature's own id, the
    name or the row number; a region keeps the features whose filter property (trimmed) equals it.
    """
    title = meaningful(property_of(name))
    own = meaningful(F.col("feature_id"))
    ident = F.coalesce(first_meaningful([property_of(c) for c in ids]) if ids else F.lit(None), own, title, F.col("row").cast("string"))
    p = meaningful(property_of(parent)) if parent else F.lit(None).cast("string")
    out = rows.select(
        ident.alias("id"),
        F.coalesce(with_note(title, meaningful(property_of(note)) if note else F.lit(None).cast("string")), ident).alias("name"),
        language_map({t: property_of(language_column(pattern, t)) for t in languages}).alias("names"),
        p.alias("parent"),
        F.when(p.isNotNull(), meaningful(property_of(parent_name)) if parent_name else F.lit(None).cast("string")).alias("parent_name"),
        (meaningful(property_of(country)) if country else F.lit(None).cast("string")).alias("country"),
        (meaningful(property_of(filter_column)) if filter_column else F.lit(None).cast("string")).alias("region"),
        polygons(F.col("geometry")).alias("geometry"),
    )
    return out.where(F.col("region") == region) if region is not None else out


def places(rows: DataFrame, languages: Sequence[str] = ()) -> DataFrame:
    """Capitals of `records`: (id, name, names, kind, country, wikidata, lon, lat), one row an id."""
    kind = F.lower(F.trim(property_of("FEATURECLA")))
    rank = F.when(kind.isin(*COUNTRY_CAPITALS), 0).when(kind.isin(*REGION_CAPITALS), 1)
    at = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<double>")
    name = F.when(F.trim(property_of("NAME")) != "", F.trim(property_of("NAME")))
    out = rows.withColumn("rank", rank).where("rank is not null").select(
        F.coalesce(property_of("NE_ID"), name).alias("id"), name.alias("name"),
        language_map({t: property_of(language_column("NAME_{lang}", t)) for t in languages}).alias("names"),
        "rank", F.trim(property_of("ADM0_A3")).alias("country"), property_of("WIKIDATAID").alias("wikidata"),
        F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat"), "row",
    ).where("name is not null and lon is not null and lat is not null")
    first = out.groupBy("id").agg(F.min_by(F.struct(*[c for c in out.columns if c not in ("id", "row")]), "row").alias("p"))
    return first.select("id", "p.*")


def regions(found: DataFrame) -> DataFrame:
    """Distinct filter values in order."""
    return found.where("region is not null").select("region").distinct().orderBy("region")


def to_text(features_: DataFrame, key: str, ident: Column, properties: Column, geometry: Column) -> DataFrame:
    """One FeatureCollection text a `key`, features in order of id."""
    f = F.struct(F.lit("Feature").alias("type"), ident.alias("id"), properties.alias("properties"), geometry.alias("geometry"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ident.alias("o"), F.to_json(f).alias("f")))), lambda x: x["f"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}"))
    return features_.groupBy(key).agg(text.alias("text"))
