"""Capitals, point labels, language variants and worldviews."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial
from .labels import Places, beside


def shown_capitals(places: DataFrame, subject: DataFrame, bounds: tuple[float, float, float, float], mode: str, cell: float = 64.0) -> DataFrame:
    """Capitals to draw, with `within` and `priority`.

    places: (pid, rank, x, y) in pixels, rank 0 a country's and 1 a region's capital; subject: (id, box,
    edges). They lie 2 pixels inside the bounds; regional ones only within the subject. Those within come
    first, then countries', then by id.
    """
    if mode == "none":
        return places.where(F.lit(False)).withColumn("within", F.lit(False))
    x0, y0, x1, y1 = bounds
    kept = places.where("rank = 0") if mode == "countries" else places
    kept = kept.where(F.col("x").between(x0 + 2, x1 - 2) & F.col("y").between(y0 + 2, y1 - 2))
    hits = spatial.points_in_polygons(kept.select("pid", "x", "y"), subject, cell).select("pid").distinct().withColumn("within", F.lit(True))
    out = kept.join(hits, "pid", "left").withColumn("within", F.coalesce("within", F.lit(False)))
    return out.where(F.col("within") | (F.col("rank") == 0)).withColumn("priority", F.struct(~F.col("within"), F.col("rank"), F.col("pid")))


def point_labels(points: DataFrame, size: float, bounds: tuple[float, float, float, float], reserved: Sequence[tuple[float, float, float, float]] = ()) -> DataFrame:
    """Labels beside points (map, pid, text, x, y, order): right, left, above, below; the first that is free and within the bounds.

    Earlier labels take their place first, so one map is one group; `reserved` boxes are taken on every map.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(["order", "pid"])
        found = beside(list(zip(own["pid"], own["text"], own["x"], own["y"])), size, bounds, Places(8 * size, reserved))
        return pd.DataFrame([(rows["map"].iloc[0], i, f.x, f.y) for i, f in found.items()], columns=["map", "pid", "x", "y"])

    return points.select("map", "pid", "text", "x", "y", "order").groupBy("map").applyInPandas(run, "map long, pid long, x double, y double")


def language_variants(labels: DataFrame, default: str) -> DataFrame:
    """(feature, lang, text): variants that differ from the default; a label that did not fit is an empty text.

    labels: (feature, lang, text). Every language has a row for each feature that the default or it labels.
    """
    base = labels.where(F.col("lang") == default).select("feature", F.col("text").alias("base"))
    other = labels.where(F.col("lang") != default)
    langs = other.select("lang").distinct()
    wanted = base.select("feature").join(F.broadcast(langs))  # a handful of language tags
    rows = wanted.unionByName(other.select("feature", "lang")).distinct()
    out = rows.join(other, ["feature", "lang"], "left").join(base, "feature", "left")
    return out.where(~F.col("text").eqNullSafe(F.col("base"))).select("feature", "lang", F.coalesce("text", F.lit("")).alias("text"))


def tag_order(lang: Column) -> Column:
    """Sort key that puts the most specific tag first."""
    return -F.size(F.split(lang, "-"))


def worldview_labels(views: DataFrame, countries: DataFrame) -> DataFrame:
    """(code, label) of views that have a file: 'Name (code)', or the code without a country."""
    code = F.when(F.col("code") == "BDG", "BGD").otherwise(F.col("code"))
    named = views.where("has_file").withColumn("id", code).join(countries.select("id", "name"), "id", "left")
    label = F.when(F.col("code") == "ISO", "ISO 3166").when(F.col("name").isNotNull(), F.concat("name", F.lit(" ("), "code", F.lit(")"))).otherwise(F.col("code"))
    return named.select("code", label.alias("label"))
