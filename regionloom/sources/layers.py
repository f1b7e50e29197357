"""Layers by file kind, dataset catalogues and hosted crosswalks."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_meaningful, language_column, language_map, meaningful, with_note
from ..operators import spatial
from . import geojson, gpkg


@dataclass(frozen=True)
class LayerQuery:
    """What to read of a layer: which columns are the identifier, the name and so on."""

    table: str | None = None
    id_columns: Sequence[str] = ()
    name_column: str = "name"
    note_column: str | None = None
    filter_column: str | None = None
    parent_column: str | None = None
    parent_name_column: str | None = None
    country_column: str | None = None
    languages: Sequence[str] = field(default_factory=tuple)
    language_pattern: str = "NAME_{lang}"


def kind(path: str) -> str:
    """'gpkg' or 'geojson' by the file's extension."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("gpkg", "sqlite"):
        return "gpkg"
    if ext in ("geojson", "json"):
        return "geojson"
    raise ValueError(f"{path}: a layer is a .gpkg, .sqlite, .geojson or .json file")


def read_layer(spark: SparkSession, path: str, query: LayerQuery, region: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features (id, name, names, parent, parent_name, country, region, geometry, x0, y0, x1, y1).

    A GeoPackage compares the region as stored, a GeoJSON its trimmed value. The box is pushed into an
    indexed GeoPackage; elsewhere it filters the features' boxes.
    """
    q = query
    if region is not None and q.filter_column is None:
        raise ValueError("a region needs a filter column")
    args = (list(q.id_columns), q.name_column, q.filter_column)
    more = {"note": q.note_column, "parent": q.parent_column, "parent_name": q.parent_name_column, "country": q.country_column, "languages": q.languages, "pattern": q.language_pattern}
    if kind(path) == "geojson":
        out = geojson.features(geojson.records(geojson.read_text(spark, path)), *args, region, **more)
    else:
        rows = gpkg.read(gpkg.load(spark, path), q.table, q.filter_column, region, box)
        rows = rows.withColumn("row", F.col("fid")).withColumn("feature_id", F.lit(None).cast("string"))
        out = _features(rows, q)
    out = out.withColumns(spatial.polygon_box("geometry"))
    return out.where(spatial.in_box(*box)) if box is not None and kind(path) == "geojson" else out


def _features(rows: DataFrame, q: LayerQuery) -> DataFrame:
    p = lambda name: meaningful(geojson.property_of(name)) if name else F.lit(None).cast("string")
    ident = F.coalesce(first_meaningful([geojson.property_of(c) for c in q.id_columns]) if q.id_columns else F.lit(None), p(q.name_column), F.col("row").cast("string"))
    return rows.select(
        ident.alias("id"), F.coalesce(with_note(p(q.name_column), p(q.note_column)), ident).alias("name"),
        language_map({t: geojson.property_of(language_column(q.language_pattern, t)) for t in q.languages}).alias("names"),
        p(q.parent_column).alias("parent"), F.when(p(q.parent_column).isNotNull(), p(q.parent_name_column)).alias("parent_name"),
        p(q.country_column).alias("country"), p(q.filter_column).alias("region"), "geometry",
    )


@dataclass(frozen=True)
class Dataset:
    """One dataset of a catalogue: a file, a file for each region, or a composition of others."""

    id: str
    file: str | None = None
    pattern: str | None = None
    parts: tuple[str, ...] = ()
    filter_column: str | None = None
    license: str | None = None
    release: str | None = None


def read_catalogue(text: str) -> dict[str, Dataset]:
    """Datasets of a TOML text ([[dataset]] tables); unknown keys, repeats and unclear kinds fail."""
    found: dict[str, Dataset] = {}
    for raw in tomllib.loads(text).get("dataset", []):
        unknown = set(raw) - {"id", "file", "pattern", "parts", "filter_column", "license", "release"}
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        d = Dataset(**raw | {"parts": tuple(raw.get("parts", ()))})
        if d.id in found or sum(map(bool, (d.file, d.pattern, d.parts))) != 1:
            raise ValueError(f"{d.id}: repeated, or not exactly one of file, pattern and parts")
        if d.pattern and "{region}" not in d.pattern:
            raise ValueError(f"{d.id}: the pattern lacks {{region}}")
        found[d.id] = d
    for d in found.values():
        missing = [p for p in d.parts if p not in found]
        if missing:
            raise ValueError(f"{d.id}: no dataset {', '.join(missing)}")
    return found


def regions_of_files(files: DataFrame, pattern: str) -> DataFrame:
    """(region, path) of files (path) that fit a '{region}' pattern."""
    before, _, after = pattern.partition("{region}")
    name = F.regexp_extract("path", re.escape(before) + "([^/]+?)" + re.escape(after) + "$", 1)
    return files.select(name.alias("region"), "path").where("region <> ''")


def worldview_path(path: str, view: str, known: Sequence[str]) -> str:
    """The file of a point of view beside the neutral one."""
    if view.upper() not in known:
        raise ValueError(f"unknown worldview {view}")
    stem, dot, ext = path.rpartition(".")
    return f"{stem}_{view.lower()}{dot}{ext}"


def load_crosswalks(spark: SparkSession, folder: str) -> DataFrame:
    """(crosswalk, from, to, weight) of all CSV files of a folder, by file name."""
    from ..functions.scalars import strict_double

    rows = spark.read.csv(f"{folder.rstrip('/')}/*.csv", header=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    weight = strict_double(F.col("weight")) if "weight" in rows.columns else F.lit(None).cast("double")
    return rows.select(name.alias("crosswalk"), "from", "to", weight.alias("weight")).where("`from` is not null and `to` is not null")


def provenance(records: DataFrame, defaults: Mapping[str, str | None], sets: DataFrame | None = None, key: str = "") -> DataFrame:
    """Sidecar values over those of the record's data set (`sets`, one row each, met on `key`), over constants."""
    if sets is not None:
        told = [c for c in sets.columns if c != key]
        joined = records.join(sets.withColumnsRenamed({c: f"_{c}" for c in told}), key, "left")
        records = joined.withColumns({c: F.coalesce(c, f"_{c}") if c in records.columns else F.col(f"_{c}") for c in told}).drop(*(f"_{c}" for c in told))
    return records.withColumns({k: F.coalesce(F.col(k), F.lit(v).cast("string")) if k in records.columns else F.lit(v).cast("string") for k, v in defaults.items()})


def wanted_files(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths (path) of files named by country whose code, the stem up to its first hyphen, is wanted (code)."""
    code = F.regexp_extract("path", r"([^/.-]*)[^/]*$", 1)
    return paths.join(wanted.select(F.col("code").alias("_code")).distinct(), code == F.col("_code"), "left_semi")
