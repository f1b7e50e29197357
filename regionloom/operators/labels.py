"""Names on regions: straight inside them, curved along them, or beside them on a leader; and room for a legend.

A map is one group: a label takes its place before smaller regions' labels look for theirs. Maps run in
parallel. Taken places lie in a grid of cells, so a label looks only at its own neighbourhood; land is
found the same way. Polygons are in pixels, parts of rings, y downwards.

Regions of one area go by id. Empty texts and regions without a shape get no label; text is measured by
`functions.scalars.text_width`'s rule.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import dealt, filled

Point = tuple[float, float]
Box = tuple[float, float, float, float]

#: A character's advance, that of wide ones (first to last code point of each block), and relative sizes that are tried.
ADVANCE = 0.56
WIDE = (
    (0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF),
    (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x20000, 0x3FFFD),
)
SIZES = (1.0, 0.85, 0.7)
LINE = 1.2  # height of a line of text


@dataclass(frozen=True)
class Options:
    size: float = 11.0
    min_scale: float = 0.7
    leaders: bool = True
    curved: bool = True
    bounds: Box = (0.0, 0.0, 1000.0, 1000.0)


@dataclass
class Label:
    text: str
    kind: str
    x: float
    y: float
    size: float
    path: list[Point] = field(default_factory=list)

    def boxes(self) -> list[Box]:
        """The places that it takes."""
        h = LINE * self.size
        if self.kind == "curved":
            return [around(x, y, h, h) for x, y in self.path]
        return [around(self.x, self.y, width(self.text, self.size), h)]


def advance(c: str) -> float:
    return 1.0 if any(a <= ord(c) <= b for a, b in WIDE) else ADVANCE


def width(text: str, size: float) -> float:
    return size * sum(map(advance, text))


def around(x: float, y: float, w: float, h: float) -> Box:
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


class Places:
    """Boxes in a grid of cells; grows as places are taken."""

    def __init__(self, cell: float = 64.0, taken=()):
        self.cell, self.cells = cell, defaultdict(list)
        for b in taken:
            self.take(b)

    def _touched(self, b: Box):
        x0, y0, x1, y1 = (math.floor(v / self.cell) for v in b)
        return ((i, j) for i in range(x0, x1 + 1) for j in range(y0, y1 + 1))

    def take(self, b: Box, what=None) -> None:
        for c in self._touched(b):
            self.cells[c].append((b, what))

    def meeting(self, b: Box):
        """What lies there, boxes that touch included; some of it perhaps twice."""
        for c in self._touched(b):
            for q, what in self.cells.get(c, ()):
                if b[0] <= q[2] and q[0] <= b[2] and b[1] <= q[3] and q[1] <= b[3]:
                    yield q, what

    def free(self, b: Box) -> bool:
        return next(self.meeting(b), None) is None


class Shape:
    """A part: its outer ring and holes as edges."""

    def __init__(self, rings):
        closed = [np.array([tuple(p) for p in r], float).reshape(-1, 2) for r in rings]
        self.outer = closed[0][:-1] if len(closed[0]) > 1 and (closed[0][0] == closed[0][-1]).all() else closed[0]
        edges = [np.hstack([r, np.roll(r, -1, 0)]) for r in (self.outer, *(c[:-1] if len(c) > 1 and (c[0] == c[-1]).all() else c for c in closed[1:]))]
        self.edges = np.vstack(edges)
        areas = [abs(float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum())) / 2 for e in edges]
        self.area = areas[0] - sum(areas[1:])
        self.box = (*self.outer.min(0).tolist(), *self.outer.max(0).tolist())

    def _even_odd(self, points: np.ndarray) -> np.ndarray:
        x, y = points[:, :1], points[:, 1:]
        ax, ay, bx, by = self.edges.T
        spans = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = ax + (y - ay) / (by - ay) * (bx - ax)
        return (spans & (at > x)).sum(1) % 2 == 1

    def inside(self, points: np.ndarray) -> np.ndarray:
        """Strictly inside? Even-odd; points on an edge are not."""
        return self._even_odd(points) & (self.distance(points) > 1e-9)

    def distance(self, points: np.ndarray) -> np.ndarray:
        """To the nearest edge."""
        a, v = self.edges[:, :2], self.edges[:, 2:] - self.edges[:, :2]
        n = (v * v).sum(1)
        d = points[:, None, :] - a
        t = np.clip(np.divide((d * v).sum(2), n, out=np.zeros(d.shape[:2]), where=n > 0), 0, 1)
        return np.sqrt(((d - t[..., None] * v) ** 2).sum(2).min(1))

    def pole(self, precision: float = 0.5) -> tuple[Point, float]:
        """The point farthest from all edges inside, and how far: squares are halved while they may hold a better one, the most
        promising of them together.
        """
        x0, y0, x1, y1 = self.box
        side = min(x1 - x0, y1 - y0)
        if side <= 0:
            return (x0, y0), 0.0

        def depth(points: np.ndarray) -> np.ndarray:
            d = self.distance(points)
            return np.where(self._even_odd(points) & (d > 1e-9), d, -d)

        xs, ys = np.meshgrid(np.arange(x0, x1, side) + side / 2, np.arange(y0, y1, side) + side / 2)
        centre = np.array([[(x0 + x1) / 2, (y0 + y1) / 2]])
        points, half = np.vstack([centre, np.stack([xs.ravel(), ys.ravel()], 1)]), side / 2
        found = depth(points)
        k = int(found.argmax())
        best, far = tuple(points[0]), float(found[0])
        if found[k] > far + 1e-9:
            best, far = tuple(points[k]), float(found[k])
        heap = [(-(d + half * math.sqrt(2)), i, p[0], p[1], half) for i, (p, d) in enumerate(zip(points[1:].tolist(), found[1:].tolist()))]
        heapq.heapify(heap)
        n, most = len(heap), max(1, min(64, 50_000 // max(1, len(self.edges))))
        while heap and -heap[0][0] - far > precision:
            cells = []
            while heap and len(cells) < most and -heap[0][0] - far > precision:
                cells.append(heapq.heappop(heap)[2:])
            h = np.array([half / 2 for _, _, half in cells]).repeat(4)
            four = np.array([c[:2] for c in cells]).repeat(4, 0) + np.tile([(-1, -1), (1, -1), (-1, 1), (1, 1)], (len(cells), 1)) * h[:, None]
            found = depth(four)
            k = int(found.argmax())
            if found[k] > far + 1e-9:
                best, far = tuple(four[k].tolist()), float(found[k])
            bound = found + h * math.sqrt(2)
            hopeful = bound - far > precision
            for b, p, half in zip(bound[hopeful].tolist(), four[hopeful].tolist(), h[hopeful].tolist()):
                heapq.heappush(heap, (-b, n, p[0], p[1], half))
                n += 1
        return best, far

    def centreline(self, steps: int = 24) -> tuple[np.ndarray, np.ndarray] | None:
        """Middles of chords across the principal axis, smoothed, in reading direction, and the chords' widths; None if the
        shape isn't three times as long as wide.
        """
        closed = np.vstack([self.outer, self.outer[:1]])
        centre = self.outer.mean(0)
        (xx, xy), (_, yy) = (d := closed - centre).T @ d
        turn = 0.5 * math.atan2(2 * xy, xx - yy)
        axes = np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
        along, across = (closed - centre) @ axes.T[:, 0], (closed - centre) @ axes.T[:, 1]
        if np.ptp(along) < 3 * np.ptp(across):
            return None
        a, b = (self.edges[:, :2] - centre) @ axes.T, (self.edges[:, 2:] - centre) @ axes.T
        middles, widths, last = [], [], None
        for t in along.min() + np.ptp(along) * np.arange(1, steps) / steps:
            cut = (a[:, 0] <= t) != (b[:, 0] <= t)
            s = np.sort(a[cut, 1] + (t - a[cut, 0]) / (b[cut, 0] - a[cut, 0]) * (b[cut, 1] - a[cut, 1]))
            low, high = s[: len(s) // 2 * 2 : 2], s[1::2]
            if not len(high):
                continue
            middle = (low + high) / 2
            k = len(high) - 1 - int(np.argmax((high - low)[::-1])) if last is None else int(np.argmin(np.abs(middle - last)))
            last = middle[k]
            middles.append(centre + np.array([t, last]) @ axes)
            widths.append(high[k] - low[k])
        if len(middles) < 4:
            return None
        line, widths = np.array(middles), np.array(widths)
        for _ in range(2):
            line = np.vstack([line[:1], (line[:-2] + line[1:-1] + line[2:]) / 3, line[-1:]])
        dx, dy = line[-1] - line[0]
        back = dy > 0 if abs(dx) < 0.3 * abs(dy) else dx < 0
        return (line[::-1], widths[::-1]) if back else (line, widths)


def along(path: np.ndarray) -> np.ndarray:
    """Running length of a path."""
    return np.r_[0.0, np.cumsum(np.hypot(*np.diff(path, axis=0).T))]


def point_at(path: np.ndarray, length: np.ndarray | float) -> np.ndarray:
    """Points of a path at the given lengths; beyond its ends the ends."""
    run = along(path)
    return np.stack([np.interp(length, run, path[:, 0]), np.interp(length, run, path[:, 1])], -1)


def letters(path: list[Point], text: str, size: float) -> list[tuple[str, float, float, float]]:
    """Each character with its centre on the path and the path's direction there in degrees, taken over the character's
    own width; the text is centred on the path.
    """
    p = np.array(path, float)
    steps = np.array([advance(c) * size for c in text])
    end = np.cumsum(steps) + (along(p)[-1] - steps.sum()) / 2
    middle, a, b = point_at(p, end - steps / 2), point_at(p, end - steps), point_at(p, end)
    return [(c, float(m[0]), float(m[1]), math.degrees(math.atan2(w[1] - v[1], w[0] - v[0]))) for c, m, v, w in zip(text, middle, a, b)]


_EIGHT = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1), (0, -1), (0, 1), (-1, 0), (1, 0)]) / 2
_WAYS = ((1, 0), (-1, 0), (1, -1), (1, 1), (-1, -1), (-1, 1), (0, -1), (0, 1))
_PROBES = np.array([(0, 0), (-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.25, 0), (0.25, 0)])


def straight(text: str, shape: Shape, pole: Point, size: float, places: Places) -> Label | None:
    """At the pole or a little off it, where the box's corners and sides lie inside."""
    w, h = width(text, size), LINE * size
    for dx, dy in ((0, 0), (0, -0.6 * h), (0, 0.6 * h), (-0.25 * w, 0), (0.25 * w, 0)):
        x, y = pole[0] + dx, pole[1] + dy
        if shape.inside(np.array([x, y]) + _EIGHT * (w, h)).all() and places.free(around(x, y, w, h)):
            return Label(text, "straight", float(x), float(y), size)
    return None


def curved(text: str, line: tuple[np.ndarray, np.ndarray] | None, size: float, places: Places) -> Label | None:
    """Along the centreline, if it is long enough, wide enough under the text, and free there."""
    if line is None:
        return None
    path, widths = line
    run = along(path)
    w, total = width(text, size), float(run[-1])
    low, high = (total - w) / 2, (total + w) / 2
    if total < 1.1 * w or (widths[(run >= low) & (run <= high)] < 1.1 * size).any():
        return None
    used = point_at(path, low + w * np.linspace(0, 1, max(1, math.ceil(w / 4)) + 1))
    if not all(places.free(around(x, y, LINE * size, LINE * size)) for x, y in used.tolist()):
        return None
    x, y = point_at(path, total / 2).tolist()
    return Label(text, "curved", x, y, size, [tuple(p) for p in path.tolist()])


def leader(text: str, anchor: Point, size: float, bounds: Box, places: Places, land: Places) -> Label | None:
    """Beside the region in one of eight directions at three distances, within the bounds, not over land."""
    w, h = width(text, size), LINE * size
    for gap in (1.5 * size, 2.5 * size, 3.5 * size):
        for ux, uy in _WAYS:
            x, y = anchor[0] + ux * (gap + w / 2), anchor[1] + uy * (gap + h / 2)
            b = around(x, y, w, h)
            if b[0] < bounds[0] + 2 or b[1] < bounds[1] + 2 or b[2] > bounds[2] - 2 or b[3] > bounds[3] - 2 or not places.free(b):
                continue
            probes = np.array([x, y]) + _PROBES * (w, h)
            near = {id(s): s for _, s in land.meeting(b)}.values()
            if not any(s.inside(probes).any() for s in near):
                return Label(text, "leader", float(x), float(y), size, [tuple(map(float, anchor)), (float(x - ux * w / 2), float(y - uy * h / 2))])
    return None


Middle = tuple[Point, float, tuple[np.ndarray, np.ndarray] | None]


def main_part(parts: list[Shape]) -> Shape:
    return max(parts, key=lambda s: s.area)


def shapes_of(geometry) -> list[Shape]:
    return [Shape(p) for p in geometry if len(p) and len(p[0]) >= 3] if geometry is not None else []


def middles(curved: bool):
    """A pandas UDF: of each geometry's largest part the pole (x, y, distance) and the centreline (x, y, width)."""

    def run(geometry: pd.Series) -> pd.DataFrame:
        rows = []
        for parts in map(shapes_of, geometry):
            shape = main_part(parts) if parts else None
            (at, radius), line = shape.pole() if parts else ((None, None), None), shape.centreline() if parts and curved else None
            rows.append(([*at, radius] if parts else None, None if line is None else np.column_stack(line).tolist()))
        return pd.DataFrame(rows, columns=["pole", "line"])

    return F.pandas_udf(run, "pole array<double>, line array<array<double>>")


def middle_of(pole, line) -> Middle | None:
    if pole is None:
        return None
    path = None if line is None else np.array([tuple(p) for p in line], float)
    return (float(pole[0]), float(pole[1])), float(pole[2]), None if path is None else (path[:, :2], path[:, 2])


def place(regions: list[tuple[int, str, list]], options: Options, reserved=(), known: dict[int, Middle] | None = None) -> dict[int, Label]:
    """Labels of one map's regions (id, text, geometry): the largest first, at full size straight, then curved, then smaller,
    and at last on a leader if the region is narrow. `known`: poles, their distances and centrelines that are worked out already.
    """
    shapes = {i: shapes_of(g) for i, _, g in regions if g is not None}
    land = Places()
    for parts in shapes.values():
        for s in parts:
            land.take(s.box, s)
    places, out = Places(taken=reserved), {}
    main = {i: main_part(parts) for i, parts in shapes.items() if parts}
    texts = {i: t for i, t, _ in regions}
    sizes = [s * options.size for s in SIZES if s >= min(1.0, max(0.1, options.min_scale)) - 1e-9]
    for i in sorted(main, key=lambda i: (-main[i].area, i)):
        text, shape = texts[i], main[i]
        if not (text or "").strip():
            continue
        if known is not None:
            pole, radius, line = known[i]
        else:
            (pole, radius), line = shape.pole(), shape.centreline() if options.curved else None
        found = None
        for size in sizes:
            found = straight(text, shape, pole, size, places) or curved(text, line, size, places)
            if found:
                break
        if not found and options.leaders and radius < 2 * options.size:
            found = leader(text, pole, sizes[-1], options.bounds, places, land)
        if found:
            out[i] = found
            for b in found.boxes():
                places.take(b)
    return out


LABEL = "map long, id long, text string, kind string, x double, y double, size double, path array<array<double>>"


def place_labels(regions: DataFrame, options: Options = Options(), reserved: DataFrame | None = None) -> DataFrame:
    """Labels of regions (map, id, text, geometry), clear of reserved boxes (map, x0, y0, x1, y1): kind, centre, size and path;
    the path is a curved label's line, or a leader's two ends. Poles and centrelines are worked out region by region on all cores.
    """

    def rows(map_: int, own: pd.DataFrame, taken: list[Box]) -> pd.DataFrame:
        known = {i: middle_of(p, line) for i, p, line in zip(own["id"], own["pole"], own["line"])}
        found = place(list(zip(own["id"], own["text"], own["geometry"])), options, taken, known)
        out = [(map_, i, f.text, f.kind, f.x, f.y, f.size, [list(p) for p in f.path]) for i, f in sorted(found.items())]
        return pd.DataFrame(out, columns=[c.split()[0] for c in LABEL.split(", ")])

    regions = dealt(regions.select("map", "id", "text", filled("geometry")[0].alias("geometry")).where("geometry IS NOT NULL"))
    regions = regions.withColumn("_m", middles(options.curved)("geometry")).select("*", "_m.pole", "_m.line").drop("_m")
    if reserved is None:
        return regions.groupBy("map").applyInPandas(lambda key, own: rows(key[0], own, []), LABEL)

    def with_reserved(key: tuple, own: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        return rows(key[0], own, list(taken[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)))

    return regions.groupBy("map").cogroup(reserved.groupBy("map")).applyInPandas(with_reserved, LABEL)


#: Sizes of the names of places and of neighbours beside those of the regions.
PLACE_SCALE = 0.85
CONTEXT_SCALE = 0.9
DOT = 6.0

PANEL = "map long, lang string, layer string, " + LABEL.split(", ", 1)[1]


def beside(points: list[tuple[int, str, float, float]], size: float, bounds: Box, places: Places) -> dict[int, Label]:
    """Names beside points, in the given order: right, left, above, below; the first place that is free and within the bounds."""
    out = {}
    for i, text, px, py in points:
        if not (text or "").strip():
            continue
        w, h, gap = width(text, size), LINE * size, 0.45 * size
        for x, y in ((px + gap + w / 2, py), (px - gap - w / 2, py), (px, py - gap - h / 2), (px, py + gap + h / 2)):
            b = around(x, y, w, h)
            if b[0] >= bounds[0] + 1 and b[1] >= bounds[1] + 1 and b[2] <= bounds[2] - 1 and b[3] <= bounds[3] - 1 and places.free(b):
                places.take(b)
                out[i] = Label(text, "straight", x, y, size)
                break
    return out


def outline(label: Label) -> Box:
    """The box around a whole label; a curved one's line with half a line of text above and below."""
    if label.kind != "curved":
        return label.boxes()[0]
    xs, ys = zip(*label.path)
    return min(xs), min(ys) - 0.6 * label.size, max(xs), max(ys) + 0.6 * label.size


def panel_labels(subject: DataFrame, places: DataFrame, context: DataFrame, languages: list[str], options: Options = Options(), reserved: DataFrame | None = None) -> DataFrame:
    """All names of a map in its own language ('') and others: regions first, then places clear of them, then neighbours.

    subject and context: (map, id, name, names map, geometry); places: (map, id, name, names, x, y), in order of id; a name that a
    language lacks stays as it is. Dots and reserved boxes (map, x0, y0, x1, y1) are taken for every name. A map and language
    are one group.
    """
    lang = F.explode(F.array(F.lit(""), *map(F.lit, languages))).alias("lang")
    box = [F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    none = F.lit(None).cast("array<array<array<array<double>>>>").alias("geometry")

    def rows(df: DataFrame, layer: str, *columns) -> DataFrame:
        text = F.coalesce(F.try_element_at("names", F.col("lang")), F.col("name")).alias("text")
        return df.select("*", lang).select("map", "lang", F.lit(layer).alias("layer"), "id", text, *columns)

    def boxes(df: DataFrame) -> DataFrame:
        return df.select("*", lang).select("map", "lang", F.lit("box").alias("layer"), F.lit(0).cast("long").alias("id"), F.lit("").alias("text"), none, "x0", "y0", "x1", "y1")

    at = [F.col("x").alias("x0"), F.col("y").alias("y0"), *box[2:]]
    parts = rows(subject, "region", *filled_as("geometry"), *box).unionByName(rows(context, "context", *filled_as("geometry"), *box)).unionByName(rows(places, "place", none, *at))
    if reserved is not None:
        parts = parts.unionByName(boxes(reserved))

    def run(key: tuple, given: pd.DataFrame) -> pd.DataFrame:
        layer = {name: g for name, g in given.groupby("layer")}
        none_ = given.iloc[:0]
        points = layer.get("place", none_).sort_values("id")
        taken = list(layer.get("box", none_)[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        taken += [around(x, y, DOT, DOT) for x, y in zip(points["x0"], points["y0"])]
        shapes = {name: list(zip(g["id"], g["text"], g["geometry"])) for name, g in layer.items()}
        found = {"region": place(shapes.get("region", []), options, taken)}
        taken += map(outline, found["region"].values())
        found["place"] = beside(list(zip(points["id"], points["text"], points["x0"], points["y0"])), PLACE_SCALE * options.size, options.bounds, Places(taken=taken))
        taken += map(outline, found["place"].values())
        small = replace(options, size=CONTEXT_SCALE * options.size, min_scale=0.8, leaders=False)
        found["context"] = place(shapes.get("context", []), small, taken)
        out = [(*key, name, i, f.text, f.kind, f.x, f.y, f.size, [list(p) for p in f.path]) for name, labels in found.items() for i, f in labels.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in PANEL.split(", ")])

    return parts.groupBy("map", "lang").applyInPandas(run, PANEL)


def filled_as(name: str) -> list:
    return [filled(name)[0].alias(name)]


#: Where a legend may be anchored (0 start, 1 centre, 2 end of width and height), in reading order, and its least side.
POSITIONS = tuple((f"{v}-{h}" if (h, v) != ("center", "middle") else "center", i, j) for j, v in enumerate(("top", "middle", "bottom")) for i, h in enumerate(("left", "center", "right")))
LEAST_SIDE = 48.0


def slots(land: np.ndarray, used: np.ndarray, cell: float) -> list[tuple[str, float, float, float, float, float]]:
    """(position, x, y, width, height, land share): for each position the largest rectangle of unused cells anchored there, a
    cell off the edge; the largest first. Narrow ones count as none; the share is that of the ninth of the map that lies there.
    """
    rows, cols = used.shape
    total = np.zeros((rows + 1, cols + 1), np.int64)
    total[1:, 1:] = used.cumsum(0).cumsum(1)
    least = math.ceil(LEAST_SIDE / cell)
    start = lambda anchor, size, whole, margin: (margin, (whole - size) // 2, whole - margin - size)[anchor]
    found = []
    for order, (name, ax, ay) in enumerate(POSITIONS):
        best = (0, 0, 0)
        hs = np.arange(1, max(1, rows - 1))
        r0 = np.array([start(ay, int(h), rows, 1) for h in hs], np.int64)
        for w in range(1, cols - 1):
            c0 = start(ax, w, cols, 1)
            taken = total[r0 + hs, c0 + w] - total[r0, c0 + w] - total[r0 + hs, c0] + total[r0, c0]
            full = np.flatnonzero(taken)
            h = int(full[0]) if len(full) else len(hs) if rows > 2 else 0
            if w >= least and h >= least and w * h > best[0]:
                best = (w * h, w, h)
        area, w, h = best
        sw, sh = max(1, cols // 3), max(1, rows // 3)
        c, r = start(ax, sw, cols, 0), start(ay, sh, rows, 0)
        share = round(float(land[r : r + sh, c : c + sw].sum()) / (sw * sh), 3)
        found.append((-area, order, (name, start(ax, w, cols, 1) * cell, start(ay, h, rows, 1) * cell, w * cell, h * cell, share)))
    return [s for _, _, s in sorted(found)]


def mark(grid: np.ndarray, box: Box, cell: float, pad: float = 0.0) -> None:
    """Cells that a pixel box, grown by `pad`, touches are taken."""
    rows, cols = grid.shape
    x0, y0 = (max(0, math.floor((v - pad) / cell)) for v in box[:2])
    x1, y1 = max(0, min(cols, math.ceil((box[2] + pad) / cell))), max(0, min(rows, math.ceil((box[3] + pad) / cell)))
    grid[y0:y1, x0:x1] = True


SLOT = "map long, position string, x double, y double, width double, height double, land_share double"


def legend_slots(grid: DataFrame, cell: float = 6.0, marks: DataFrame | None = None) -> DataFrame:
    """Nine legend places a map from its raster (map, row, col, land), without the marks (map, x0, y0, x1, y1, pad, solid);
    solid ones count as land. One map is one group.
    """

    def rows(map_: int, cells: pd.DataFrame, boxes: list) -> pd.DataFrame:
        land = np.zeros((int(cells["row"].max()) + 1, int(cells["col"].max()) + 1), bool)
        land[cells["row"], cells["col"]] = cells["land"]
        used = land.copy()
        for x0, y0, x1, y1, pad, solid in boxes:
            for g in (used, land)[: 1 + bool(solid)]:
                mark(g, (x0, y0, x1, y1), cell, pad)
        return pd.DataFrame([(map_, *s) for s in slots(land, used, cell)], columns=[c.split()[0] for c in SLOT.split(", ")])

    if marks is None:
        return grid.groupBy("map").applyInPandas(lambda key, cells: rows(key[0], cells, []), SLOT)

    def marked(key: tuple, cells: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame([], columns=[c.split()[0] for c in SLOT.split(", ")])
        return rows(key[0], cells, list(boxes[["x0", "y0", "x1", "y1", "pad", "solid"]].itertuples(index=False, name=None)))

    return grid.groupBy("map").cogroup(marks.groupBy("map")).applyInPandas(marked, SLOT)
