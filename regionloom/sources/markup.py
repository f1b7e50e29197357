"""Codes in SVG text; parameters in recipes and wikitext."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import xml_unescape


def svg_codes(documents: DataFrame, column: str) -> DataFrame:
    """(code, unit) of every land path; neighbours, lakes and borders do not count."""
    tags = documents.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<path\b[^>]*>"), F.lit(0))).alias("tag"))
    land = tags.where(F.regexp_extract("tag", r'\sclass="([^"]*)"', 1).rlike(r"(^|\s)mg-land(\s|$)") & F.col("tag").rlike(r'\sdata-code="'))
    code = xml_unescape(F.regexp_extract("tag", r'\sdata-code="([^"]*)"', 1))
    unit = F.when(F.col("tag").rlike(r'\sdata-unit="'), xml_unescape(F.regexp_extract("tag", r'\sdata-unit="([^"]*)"', 1)))
    units = F.explode_outer(F.split(unit, r"\s+")).alias("unit")
    return land.select(code.alias("code"), units).distinct()


def parse_recipe(text: str) -> dict:
    """Options of a recipe: 'key,value' lines ('#' comments, optional header), or a table of regions.

    Values of a repeated key and comma lists under 'regions' become lists.
    """
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text.lstrip("﻿")), skipinitialspace=True) if r and not r[0].lstrip().startswith("#")]
    rows = [r for r in rows if any(r)]
    if not rows:
        raise ValueError("empty recipe")
    head = [c.lower() for c in rows[0]]
    if head[0] in ("region", "regions", "code") and (len(head) == 1 or head[1:] != ["value"]):
        return {"regions": [r[0] for r in rows[1:] if r[0]]}
    if head[:2] == ["key", "value"]:
        rows = rows[1:]
    out: dict = {"regions": []}
    for r in rows:
        key, values = r[0].lower(), [v for v in r[1:] if v]
        if key in ("region", "regions"):
            out["regions"] += [x.strip() for v in values for x in re.split(r"[;,]", v) if x.strip()]
        elif key in out:
            raise ValueError(f"{key} is given twice")
        else:
            out[key] = ",".join(values)
    return out


def recipe_text(recipe: dict) -> str:
    """The recipe as 'key,value' lines in order of key."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["key", "value"])
    for key in sorted(k for k in recipe if k != "regions"):
        w.writerow([key, recipe[key]])
    for region in recipe.get("regions", []):
        w.writerow(["region", region])
    return out.getvalue()


def template(text: str, name: str) -> dict[str, str] | None:
    """Parameters of the first {{name|...}} of a wikitext; nested brackets stay whole."""
    start = re.search(r"\{\{\s*" + re.escape(name) + r"\s*(?=[|}])", text, re.I)
    if not start:
        return None
    depth, at, parts, last = 1, start.end(), [], start.end()
    while at < len(text) and depth:
        two = text[at : at + 2]
        if two in ("{{", "[["):
            depth, at = depth + 1, at + 2
        elif two in ("}}", "]]"):
            depth, at = depth - 1, at + 2
            if not depth:
                parts.append(text[last : at - 2])
        else:
            if text[at] == "|" and depth == 1:
                parts.append(text[last:at])
                last = at + 1
            at += 1
    if depth:
        raise ValueError("a template is not closed")
    out: dict[str, str] = {}
    for i, p in enumerate(parts[1:], 1):
        key, eq, value = p.partition("=")
        out[key.strip() if eq else str(i)] = (value if eq else p).strip()
    return out
