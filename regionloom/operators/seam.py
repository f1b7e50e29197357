"""Polygons and lines cut at the seam of a map centred on any longitude.

Longitudes become relative to the centre and continuous along a ring or line; each is its own wrapped
value plus whole turns, so a vertex that two rings share stays the same in both. What doesn't reach
over the seam keeps its coordinates. A ring around a pole is closed along that pole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlay


def unwrapped(p: np.ndarray, lon0: float) -> np.ndarray:
    """Points relative to lon0, each within half a turn of the one before; the first in [-180, 180)."""
    rel = (p[:, 0] - lon0 + 180.0) % 360.0 - 180.0
    step = np.diff(rel)
    turns = np.r_[0.0, np.cumsum(np.round(-step / 360.0))]
    return np.stack([rel + 360.0 * turns, p[:, 1]], 1)


def _ring(p: np.ndarray, lon0: float) -> np.ndarray:
    """A closed ring, unwrapped; one that goes once round is led over the nearer pole."""
    if len(p) and (p[0] == p[-1]).all():
        p = p[:-1]
    r = unwrapped(np.vstack([p, p[:1]]), lon0)
    if abs(r[-1, 0] - r[0, 0]) > 180:
        pole = 90.0 if r[:, 1].mean() >= 0 else -90.0
        return np.vstack([r, [[r[-1, 0], pole], [r[0, 0], pole]], r[:1]])
    return r


def _middle(r: np.ndarray) -> float:
    return float(r[:, 0].min() + r[:, 0].max()) / 2


def split_polygon(rings: list, lon0: float) -> list[list]:
    """Parts of a polygon (rings of points) within half a turn of lon0."""
    given = [np.array([tuple(q) for q in r], float).reshape(-1, 2) for r in rings]
    if not given or len(given[0]) < 3:
        return []
    outer = _ring(given[0], lon0)
    outer[:, 0] -= 360.0 * np.floor((_middle(outer) + 180) / 360)
    holes = [_ring(h, lon0) for h in given[1:] if len(h) >= 3]
    for h in holes:
        h[:, 0] -= 360.0 * np.round((_middle(h) - _middle(outer)) / 360)
    low, high = outer[:, 0].min(), outer[:, 0].max()
    if low >= -180 and high <= 180:
        return [[(r + [lon0, 0]).tolist() for r in (outer, *holes)]]
    shape, out = [[r.tolist() for r in (outer, *holes)]], []
    for turn in range(int(np.floor((low + 180) / 360)), int(np.ceil((high - 180) / 360)) + 1):
        w, e = 360.0 * turn - 180, 360.0 * turn + 180
        strip = [[[[w, -90.0], [e, -90.0], [e, 90.0], [w, 90.0], [w, -90.0]]]]
        out += [[[[x - 360.0 * turn + lon0, y] for x, y in r] for r in part] for part in overlay.intersections([[shape, strip]])[0]]
    return out


def split_line(points: list, lon0: float) -> list[list]:
    """Pieces of a line within half a turn of lon0; ends on the seam are interpolated."""
    p = np.array([tuple(q) for q in points], float).reshape(-1, 2)
    if len(p) < 2:
        return []
    r = unwrapped(p, lon0)
    r[:, 0] -= 360.0 * np.floor((_middle(r) + 180) / 360)
    if r[:, 0].min() >= -180 and r[:, 0].max() <= 180:
        return [(r + [lon0, 0]).tolist()]
    pieces, now, turn = [], [], None
    for a, b in zip(r[:-1], r[1:]):
        seams = np.arange(np.ceil((min(a[0], b[0]) + 180) / 360), np.floor((max(a[0], b[0]) + 180) / 360) + 1) * 360 - 180
        inside = [s for s in (seams if b[0] >= a[0] else seams[::-1]) if s not in (a[0], b[0])]
        stops = [a, *(np.array([s, a[1] + (s - a[0]) / (b[0] - a[0]) * (b[1] - a[1])]) for s in inside), b]
        for u, v in zip(stops[:-1], stops[1:]):
            k = np.floor(((u[0] + v[0]) / 2 + 180) / 360)
            if k != turn:
                now = [[u[0] - 360 * k + lon0, u[1]]]
                pieces.append(now)
                turn = k
            now.append([v[0] - 360 * k + lon0, v[1]])
    return [[[float(x), float(y)] for x, y in piece] for piece in pieces]


def split_at_seam(features: DataFrame, lon0: float) -> DataFrame:
    """(id, geometry): polygons with their holes, parts that reach over the seam cut there. Null and empty geometries stay."""
    kind = features.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = [[part for rings in g for part in split_polygon(rings, lon0)] for g in b["geometry"]]
            yield pd.DataFrame({"id": b["id"], "geometry": pd.Series(shapes, b.index, dtype=object)})

    shape = "array<array<array<array<double>>>>"
    full = F.coalesce(F.size("geometry") > 0, F.lit(False))
    split = features.where(full).select("id", "geometry").mapInPandas(run, f"id {kind}, geometry {shape}")
    return split.unionByName(features.where(~full).select("id", F.col("geometry").cast(shape).alias("geometry")))


def split_lines_at_seam(lines: DataFrame, lon0: float) -> DataFrame:
    """(id, piece, points) of lines (id, points)."""
    kind = lines.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, piece) for i, line in zip(b["id"], b["points"]) for k, piece in enumerate(split_line(line, lon0))]
            yield pd.DataFrame(rows, columns=["id", "piece", "points"])

    return lines.where("points IS NOT NULL").select("id", "points").mapInPandas(run, f"id {kind}, piece int, points array<array<double>>")
