"""Choropleth templates of an encyclopedia's wikitext as recipes: regions, their values, view, texts and notes.

A text without the template, or whose template lists no regions, has no recipe. The first template counts, and
of a repeated parameter the first that isn't blank.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame



#: Boxes by name (west, south, east, north in degrees are the reader's), the template's size and a map's width in pixels.
VIEWS = ("europe", "africa", "asia", "north-america", "south-america", "oceania", "middle-east", "caribbean")
TEMPLATE_SIZE = (250.0, 200.0)
WIDTH = 1000.0
COLOURING = ("color", "min-opacity", "logarithmic-scale", "legends")
LAYOUT = ("align", "frameless")
LISTS = ("countries", "entities", "states", "provinces")
KNOWN = (*LISTS, *COLOURING, *LAYOUT, "view", "latitude", "longitude", "zoom", "width", "height", "mapstyle", "alt", "caption", "source")

_BRACKETS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def parameters(text: str) -> list[tuple[str, str]] | None:
    """Named parameters, keys in lower case, of the first choropleth map template; nested templates and links stay whole."""
    start = re.search(r"\{\{\s*(?:Template:)?\s*choropleth[ _]+map\s*(?=[|}]|$)", text, re.I)
    if not start:
        return None
    depth, cuts, end = 0, [], len(text)
    for m in _BRACKETS.finditer(text, start.end()):
        if m[0] == "|":
            cuts += [m.start()] * (depth == 0)
        elif m[0] in ("{{", "[["):
            depth += 1
        elif depth:
            depth -= 1
        elif m[0] == "}}":
            end = m.start()
            break
    pieces = [text[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], end])]
    named = (p.partition("=") for p in pieces)
    return [(k.strip().lower(), v) for k, eq, v in named if eq and k.strip()]


def plain(text: str) -> str:
    """Text without footnotes, templates, tags and emphasis; links by their label."""
    text = re.sub(r"<ref\b[^>]*/>|<ref\b.*?(?:</ref>|$)", "", text, flags=re.S)
    inner = re.compile(r"\{\{(?:(?!\{\{|\}\}).)*\}\}", re.S)
    while (less := inner.sub("", text)) != text:
        text = less
    text = re.sub(r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    return " ".join(re.sub(r"<[^>]*>?|'{2,3}", "", text).split())


def is_value(text: str) -> bool:
    """A colour like #faa or #D8757E, or a number, a percentage too."""
    if re.fullmatch(r"#(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})", text):
        return True
    return number(text.removesuffix("%").replace(",", "")) is not None


def number(text: str | None) -> float | None:
    try:
        found = float(text.strip()) if text and "_" not in text else None
    except ValueError:
        return None
    return found if found is not None and math.isfinite(found) else None


def entities(text: str) -> list[tuple[str, str | None]]:
    """(entity, value): lists by line and semicolon; a value or colour before a colon holds for its line."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        value, colon, rest = line.partition(":")
        valued = bool(colon) and is_value(value.strip())
        names = (plain(e) for e in (rest if valued else line).split(";"))
        out += [(n, value.strip() if valued else None) for n in names if n]
    return out


def view_box(lat: float, lon: float, zoom: float, width: float, height: float) -> str | None:
    """'west;south;east;north' of a web map of this centre, zoom and size in pixels; None if it shows the whole world."""
    degrees = 360.0 / (256.0 * 2.0**zoom)
    across, up = width * degrees / 2, height * degrees * max(abs(math.cos(math.radians(lat))), 0.05) / 2
    if across >= 180:
        return None
    return ";".join(f"{v:.2f}" for v in (lon - across, max(lat - up, -89.0), lon + across, min(lat + up, 89.0)))


def choropleth(text: str) -> dict | None:
    """dataset, regions, values (region to value), params and notes of the first template; None without regions."""
    pairs = parameters(text or "")
    given: dict[str, str] = {}
    for k, v in pairs or ():
        if v.strip():
            given.setdefault(k, v.strip())
    own = next((given[k] for k in LISTS[1:] if k in given), None)
    if pairs is None or (own is None and "countries" not in given):
        return None
    notes, params = [], {}
    listed = [e for part in (given.get("countries"), own) if part for e in entities(part)]
    if own is not None and "countries" in given:
        notes.append("both countries and entities are given: both are used")
    values = {e: v for e, v in listed if v is not None}
    valued = sum(v is not None for _, v in listed)
    if valued:
        notes.append(f"{valued} values or colours are kept for colouring")
    size = [number(re.sub(r"\s*px$", "", given.get(k, ""))) for k in ("width", "height")]
    size = [v if v and v > 0 else None for v in size]
    w, h = (v or d for v, d in zip(size, TEMPLATE_SIZE))
    if any(size):
        params["height"] = str(int(min(10_000, max(50, math.floor(WIDTH * h / w + 0.5)))))
    if given.get("width", "").lower() == "full":
        notes.append("width full is a page layout")
    at = [number(given.get(k)) for k in ("latitude", "longitude", "zoom")]
    if None not in at:
        box = view_box(*at, w, h)
        params |= {"bbox": box} if box else {"frame": "world"}
    elif at[0] is not None or at[1] is not None:
        notes.append("a place needs latitude, longitude and zoom: the map is framed on the regions")
    elif at[2] is not None:
        notes.append("zoom without latitude and longitude: the map is framed on the regions")
    if None in at and "view" in given:
        name = re.sub("[ _]", "-", given["view"].lower())
        if name in VIEWS:
            params["bbox"] = name
        elif name != "auto":
            notes.append(f"view {given['view']}: the map is framed on the regions")
    params |= {k: t for k in ("caption", "alt") if (t := plain(given.get(k, "")))}
    for keys, what in ((COLOURING, "colouring settings"), (LAYOUT, "page layout")):
        if found := [k for k in keys if k in given]:
            notes.append(f"{', '.join(found)}: {what}")
    if "mapstyle" in given:
        notes.append(f"mapstyle {given['mapstyle']}: the base map stays")
    if given.get("source", "choroplethmap.map").lower() != "choroplethmap.map":
        notes.append(f"source {given['source']}: other boundaries are used")
    notes += [f"unknown parameter {k} is ignored" for k, _ in pairs if k not in KNOWN]
    return {"dataset": "countries" if own is None else "mixed", "regions": [e for e, _ in listed], "values": values, "params": params, "notes": notes}


def without_disambiguation(title: str) -> str | None:
    """'New York (state)' as 'New York'; None for a title without words in brackets at its end."""
    found = re.fullmatch(r"\s*(.*\S) \([^()]*(?:\([^()]*\)[^()]*)*\)\s*", title)
    return found[1].strip() if found else None


RECIPE = "dataset string, regions array<string>, values map<string,string>, params map<string,string>, notes array<string>"


def choropleth_recipes(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, dataset, regions, values, params, notes) of the texts that hold a template with regions."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, r) for k, r in zip(b[key], map(choropleth, b[column])) if r]
            rows = [(k, r["dataset"], r["regions"], r["values"], r["params"], r["notes"]) for k, r in found]
            yield pd.DataFrame(rows, columns=[key, "dataset", "regions", "values", "params", "notes"])

    return texts.where(texts[column].isNotNull()).select(key, column).mapInPandas(run, f"{key} {kind}, {RECIPE}")
