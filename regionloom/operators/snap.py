"""Borders snapped onto the borders of earlier features, and repair of shapes with rollback.

A feature sees the features before it as they are after their own snapping, so the order counts, but
only between features that lie near each other. A layer of moderate size is one group. A larger one is
worked on in waves: a feature is ready as soon as all earlier features near it are done, all ready
ones snap in parallel, each with just its neighbours, and the result is that of the plain order.

Vertex rows: (layer, owner, part, ring, pos, x, y), rings closed or not; owners are in order, and one
owner belongs to one layer. A vertex goes to the nearest earlier vertex within the tolerance, else to the
nearest point of an earlier edge within it; of equally near ones to the smallest by x, then y. Vertices
that are not finite stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import overlay, rings, spatial
from .graph import cut

VERTEX = ("layer", "owner", "part", "ring", "pos", "x", "y")
GROUP_VERTICES = 200_000


def nearest_on(points: np.ndarray, segments: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point whether a segment lies within the tolerance, and the nearest point of the nearest one.

    Segments are cut to pieces no longer than a cell, points look into their own cell.
    """
    found, foot = np.zeros(len(points), bool), points.copy()
    near = np.isfinite(points).all(1)
    segments = segments[np.isfinite(segments).all(1)]
    if not len(segments) or not near.any():
        return found, foot
    low, high = points[near].min(0) - 2 * tolerance, points[near].max(0) + 2 * tolerance
    box = np.minimum(segments[:, :2], segments[:, 2:]), np.maximum(segments[:, :2], segments[:, 2:])
    segments = segments[(box[0] <= high).all(1) & (box[1] >= low).all(1)]
    if not len(segments):
        return found, foot
    length = np.abs(segments[:, 2:] - segments[:, :2]).max(1)
    cell = max(4 * tolerance, float(np.median(length)), float(length.sum()) / (16 * len(segments)), float((high - low).max()) / (1 << 20))
    count = np.maximum(1, np.ceil(length / cell)).astype(np.int64)
    owner, k = overlay._spans(np.zeros(len(segments), np.int64), count)
    step = (segments[:, 2:] - segments[:, :2])[owner] / count[owner, None]
    a = segments[owner, :2] + step * k[:, None]
    b = a + step
    lo = np.floor((np.minimum(a, b) - tolerance * 1.001 - low) / cell).astype(np.int64)
    hi = np.floor((np.maximum(a, b) + tolerance * 1.001 - low) / cell).astype(np.int64)
    size = hi - lo + 1
    piece, at = overlay._spans(np.zeros(len(lo), np.int64), size.prod(1))
    key = ((lo[piece, 0] + at // size[piece, 1]) << 32) + lo[piece, 1] + at % size[piece, 1] + (1 << 31)
    entries = np.unique(np.stack([key, owner[piece]], 1), axis=0)
    mine = np.flatnonzero(near)
    c = np.floor((points[mine] - low) / cell).astype(np.int64)
    asked = (c[:, 0] << 32) + c[:, 1] + (1 << 31)
    first = np.searchsorted(entries[:, 0], asked)
    q, e = overlay._spans(first, np.searchsorted(entries[:, 0], asked, "right") - first)
    s, p = segments[entries[e, 1]], points[mine[q]]
    v = s[:, 2:] - s[:, :2]
    n = (v * v).sum(1)
    t = np.clip(np.divide(((p - s[:, :2]) * v).sum(1), n, out=np.zeros(len(n)), where=n > 0), 0, 1)
    f = np.where((t == 1)[:, None], s[:, 2:], s[:, :2] + t[:, None] * v)
    d = ((f - p) ** 2).sum(1)
    good = d <= tolerance * tolerance
    q, f, d = q[good], f[good], d[good]
    order = np.lexsort((f[:, 1], f[:, 0], d, q))
    q, f = q[order], f[order]
    best = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    found[mine[q[best]]], foot[mine[q[best]]] = True, f[best]
    return found, foot


def _ring_starts(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (part, ring, pos): the first and the last row of each ring."""
    name = rows[["part", "ring"]].to_numpy()
    new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]).any(1)])
    return new, np.r_[new[1:], len(rows)] - 1


def _outline(rows: pd.DataFrame) -> np.ndarray:
    """The edges of a feature's rings, each ring closed by itself."""
    first, last = _ring_starts(rows)
    p = rows[["x", "y"]].to_numpy(float)
    after = np.arange(len(p)) + 1
    after[last] = first
    return np.hstack([p, p[after]])


def _snap_one(rows: pd.DataFrame, vertices: np.ndarray, edges: np.ndarray, tolerance: float) -> pd.DataFrame:
    """A feature's rows, snapped onto earlier vertices, then edges; a closing vertex follows its ring's first."""
    p = rows[["x", "y"]].to_numpy(float)
    on_vertex, v = nearest_on(p, np.hstack([vertices, vertices]), tolerance)
    on_edge, e = nearest_on(p, edges, tolerance)
    moved = np.where(on_vertex[:, None], v, np.where(on_edge[:, None], e, p))
    first, last = _ring_starts(rows)
    closed = (p[first] == p[last]).all(1) & (first < last)
    moved[last[closed]] = moved[first[closed]]
    return rows.assign(x=moved[:, 0], y=moved[:, 1])


def _in_order(rows: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """A whole layer, feature after feature; each looks only at earlier ones whose boxes are near."""
    out, boxes, shapes = [], np.zeros((0, 4)), []
    for _, f in rows.sort_values(["owner", "part", "ring", "pos"]).groupby("owner", sort=True):
        p = f[["x", "y"]].to_numpy(float)
        ok = np.isfinite(p).all(1)
        box = np.r_[p[ok].min(0), p[ok].max(0)] if ok.any() else np.full(4, np.nan)
        near = np.flatnonzero((boxes[:, 0] <= box[2] + 2 * tolerance) & (box[0] <= boxes[:, 2] + 2 * tolerance) & (boxes[:, 1] <= box[3] + 2 * tolerance) & (box[1] <= boxes[:, 3] + 2 * tolerance))
        if len(near):
            f = _snap_one(f, np.vstack([shapes[k][0] for k in near]), np.vstack([shapes[k][1] for k in near]), tolerance)
        out.append(f)
        shapes.append((f[["x", "y"]].to_numpy(float), _outline(f)))
        boxes = np.vstack([boxes, box])
    return pd.concat(out)


def _schema(vertices: DataFrame) -> str:
    return ", ".join(f"{c} {vertices.schema[c].dataType.simpleString()}" for c in VERTEX)


def snap_features(vertices: DataFrame, tolerance: float, most: int = GROUP_VERTICES) -> DataFrame:
    """The vertex rows after snapping. Layers of up to `most` vertices are one group each, larger ones go in waves."""
    rows, schema = cut(vertices.select(*VERTEX)), _schema(vertices)
    large = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("layer")
    large = cut(large)
    if not large.head(1):
        return rows.groupBy("layer").applyInPandas(lambda r: _in_order(r, tolerance), schema)
    small = rows.join(large, "layer", "left_anti").select(*VERTEX).groupBy("layer").applyInPandas(lambda r: _in_order(r, tolerance), schema)
    return small.unionByName(_in_waves(rows.join(large, "layer", "left_semi").select(*VERTEX), tolerance, schema))


def _in_waves(rows: DataFrame, tolerance: float, schema: str) -> DataFrame:
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    boxes = rows.where(finite).groupBy("layer", F.col("owner").alias("id")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    pairs = spatial.box_pairs(boxes, boxes, max(4 * tolerance, 1e-9), tolerance).where("layer = layer_b AND id < id_b")
    waits = cut(pairs.select(F.col("id").alias("before"), F.col("id_b").alias("owner")))
    left = cut(rows.select("owner").distinct())

    def snap(key: tuple, own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "ring", "pos"])
        if not len(own) or not len(seen):
            return own[list(VERTEX)]
        groups = [g.sort_values(["part", "ring", "pos"]) for _, g in seen.groupby("before")]
        vertices, edges = (np.vstack([f(g) for g in groups]) for f in (lambda g: g[["x", "y"]].to_numpy(float), _outline))
        return _snap_one(own, vertices, edges, tolerance)[list(VERTEX)]

    waves: list[DataFrame] = []
    done = None
    while left.head(1):
        blocked = waits.join(left.withColumnRenamed("owner", "before"), "before", "left_semi").select("owner").distinct()
        ready = cut(left.join(blocked, "owner", "left_anti"))
        own = rows.join(ready, "owner", "left_semi").select(*VERTEX)
        if done is None:
            wave = own
        else:
            near = waits.join(ready, "owner", "left_semi").join(done.select(F.col("owner").alias("before"), "part", "ring", "pos", "x", "y"), "before")
            wave = own.groupBy("owner").cogroup(near.groupBy("owner")).applyInPandas(snap, schema)
        waves.append(cut(wave))
        done = waves[0]
        for w in waves[1:]:
            done = done.unionByName(w)
        left = cut(left.join(ready, "owner", "left_anti"))
    return done if done is not None else rows


def _parts(rows: DataFrame) -> DataFrame:
    """(feature, part, geometry) of ring rows: every part a polygon of its own."""
    in_order = lambda at, value: F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda s: s[value])
    ring = rows.withColumn("p", F.array(F.col("x").cast("double"), F.col("y").cast("double"))).groupBy(*rings.RING).agg(in_order("pos", "p").alias("points"))
    return ring.groupBy("feature", "part").agg(F.array(in_order("ring", "points")).alias("geometry"))


def rebuilt(vertices: DataFrame, cell: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Ring rows (feature, part, ring, pos, x, y) whose invalid parts are replaced by what their edges enclose (even-odd), and those parts.

    A bow tie becomes two triangles; new parts are numbered after the feature's last one.
    """
    problems = cut(rings.polygon_problem(rings.edges(vertices), cell))
    bad = vertices.join(problems.select("feature", "part"), ["feature", "part"], "left_semi")
    last = vertices.groupBy("feature").agg((F.max("part") + 1).alias("base"))

    kinds = {c: vertices.schema[c].dataType.simpleString() for c in ("feature", "part", "ring", "pos", "x", "y")}
    built = cut(spatial.dealt(_parts(bad)).select("feature", "part", spatial.union_shape("geometry").alias("geometry")))  # batches of parts are one arrangement
    found = built.select("feature", F.col("part").alias("of"), F.posexplode("geometry").alias("at", "rings")).join(last, "feature")
    number = (F.col("base") + F.row_number().over(W.partitionBy("feature").orderBy("of", "at")) - 1).cast(kinds["part"])
    ring = found.select("feature", number.alias("part"), "rings").select("feature", "part", F.posexplode("rings").alias("ring", "points"))
    new = ring.select("feature", "part", F.col("ring").cast(kinds["ring"]).alias("ring"), F.posexplode("points").alias("pos", "p"))
    new = new.withColumns({"pos": F.col("pos").cast(kinds["pos"]), "x": F.col("p")[0].cast(kinds["x"]), "y": F.col("p")[1].cast(kinds["y"])})
    kept = vertices.join(problems.select("feature", "part"), ["feature", "part"], "left_anti")
    return kept.select(*kinds).unionByName(new.select(*kinds)), problems


def _misses(vertices: DataFrame, tolerance: float) -> tuple[int, int]:
    """Pairs of features with near misses, and their vertices."""
    v = vertices.withColumns({"pid": F.monotonically_increasing_id(), "owner": F.col("feature")})
    e = rings.edges(v).select(F.col("feature").alias("owner"), F.monotonically_increasing_id().alias("sid"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    return tuple(spatial.near_misses(cut(v), cut(spatial.dealt(e)), tolerance).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())


def repair(vertices: DataFrame, tolerance: float, cell: float = 1.0) -> tuple[DataFrame, dict[str, int | bool]]:
    """Ring rows (feature, part, ring, pos, x, y) of a layer, cleaned, and what was done.

    Near misses are snapped if there are any; then repeated vertices and degenerate rings go and invalid parts are
    rebuilt. If more pairs of features miss each other then than before, or as many in more vertices, the snapping is undone.
    """
    columns = ("feature", "part", "ring", "pos", "x", "y")
    given = cut(spatial.dealt(vertices.select(*columns)))
    before = _misses(given, tolerance)
    moved, reverted = 0, False

    def cleaned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        out, problems = rebuilt(cut(rings.clean_rings(rows)), cell)
        return cut(out), problems

    out = None
    if before[0]:
        layered = given.select(F.lit("").alias("layer"), F.col("feature").alias("owner"), *columns[1:])
        snapped = cut(snap_features(layered, tolerance).select(F.col("owner").alias("feature"), *columns[1:]))
        was = given.select(*columns[:4], F.col("x").alias("_x"), F.col("y").alias("_y"))
        ends = rings.RING
        closing = given.groupBy(*ends).agg(F.max("pos").alias("pos"), F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b")).where("a = b").select(*ends, "pos")
        moved = snapped.join(was, list(columns[:4])).where("x <> _x OR y <> _y").join(closing, list(columns[:4]), "left_anti").count()
        if moved:
            out, problems = cleaned(snapped)
            reverted = _misses(out, tolerance) > before
    if out is None or reverted:
        out, problems = cleaned(given)
        moved = 0
    repeated = rings.repeated_vertices(given).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return out, {"snapped_vertices": moved, "removed_points": int(repeated), "fixed_polygons": problems.count(), "snapping_reverted": reverted}
