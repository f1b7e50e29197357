"""SVG and HTML documents, metadata and the cache of results."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fixed, xml_escape

#: A plain theme's colours by slot.
PLAIN = {"water": "#ffffff", "land": "#e0e0e0", "border": "#808080", "outline": "#404040", "label": "#000000"}


def ring_path(vertices: DataFrame, precision: int = 1) -> DataFrame:
    """Path text of each feature from ring rows (feature, part, ring, pos, x, y) in pixels.

    Vertices are rounded first, then consecutive equal ones go; rings under three points vanish.
    """
    w = W.partitionBy("feature", "part", "ring").orderBy("pos")
    text = F.concat(fixed(F.col("x"), precision), F.lit(","), fixed(F.col("y"), precision))
    v = vertices.withColumn("t", text)
    v = v.withColumn("fresh", F.coalesce(F.col("t") != F.lag("t").over(w), F.lit(True))).where("fresh")
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"])
    rings = v.groupBy("feature", "part", "ring").agg(points.alias("p"))
    closed = F.when(F.element_at("p", 1) == F.element_at("p", -1), F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))
    rings = rings.withColumn("p", closed).where(F.size("p") >= 3)
    d = F.concat(F.lit("M"), F.array_join("p", "L"), F.lit("Z"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "ring", d.alias("d")))), lambda s: s["d"])
    return rings.groupBy("feature").agg(F.array_join(ordered, "").alias("d"))


def path_element(css: str, code: Column, name: Column, d: Column) -> Column:
    head, middle = F.lit(f'<path class="{css}" data-code="'), F.lit('" d="')
    return F.concat(head, xml_escape(code), middle, d, F.lit('"><title>'), xml_escape(name), F.lit("</title></path>"))


def svg(elements: DataFrame, key: str, layer: str, pos: str, text: str, width: int, height: int, colors: Mapping[str, str] = PLAIN) -> DataFrame:
    """One SVG document a `key` from element texts, in order of layer and position."""
    style = f".mg-land{{fill:{colors['land']};stroke:{colors['border']}}}.mg-context{{fill:{colors['land']};opacity:.6}}.mg-label{{fill:{colors['label']}}}"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(layer).alias("l"), F.col(pos).alias("p"), F.col(text).alias("t")))), lambda s: s["t"])
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}"><style>{style}</style><rect width="{width}" height="{height}" fill="{colors["water"]}"/>'
    return elements.groupBy(key).agg(F.concat(F.lit(head), F.array_join(ordered, ""), F.lit("</svg>")).alias("svg"))


def html(svg_text: Column, title: Column) -> Column:
    """A page around an SVG; its strings cannot end a script."""
    safe = F.replace(F.to_json(F.struct(title.alias("title"))), F.lit("</"), F.lit("<\\/"))
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), xml_escape(title), F.lit("</title></head><body>"), svg_text,
                    F.lit("<script>const page="), safe, F.lit(";</script></body></html>"))


def metadata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON objects."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def option_text(options: Mapping[str, object]) -> str:
    """Options as canonical text: sorted, so equal options give equal cache keys."""
    return json.dumps(dict(sorted(options.items())), ensure_ascii=False, separators=(",", ":"))


#: Bounds of render options.
BOUNDS = {"width": (16, 20000), "height": (50, 10000), "precision": (0, 6), "label_scale": (0, 1)}


def check_options(options: Mapping[str, float]) -> dict[str, float]:
    """Options within their bounds; unknown names and values outside fail."""
    for k, v in options.items():
        if k not in BOUNDS:
            raise ValueError(f"unknown option {k}")
        low, high = BOUNDS[k]
        if not low <= v <= high:
            raise ValueError(f"{k} must be between {low} and {high}")
    return dict(options)


def parse_box(text: str, presets: Mapping[str, tuple[float, float, float, float]] | None = None) -> tuple[float, float, float, float]:
    """A box: a preset's name or west,south,east,north; west may exceed east (over the antimeridian)."""
    if presets and text.strip().lower() in presets:
        return presets[text.strip().lower()]
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    w, s, e, n = parts
    if not (-180 <= w <= 180 and -180 <= e <= 180 and -90 <= s < n <= 90) or w == e:
        raise ValueError("a box lies within -180,-90,180,90 and is not empty")
    return w, s, e, n
