"""Rings as rows: (feature, part, ring, pos, x, y), closed rings repeat their first vertex.

Windows run within one ring, so nothing is sorted beyond a ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import wrap_longitude

RING = ("feature", "part", "ring")


def _along():
    return W.partitionBy(*RING).orderBy("pos")


def covering_arc(points: DataFrame, key: str, lon: str) -> DataFrame:
    """(key, start, length): the smallest arc with every longitude, by its widest gap.

    The earliest of equal gaps wins; the gap across the wrap wins over all equal ones.
    """
    w = points.select(key, wrap_longitude(F.col(lon)).alias("lon")).distinct()
    gap = F.col("lon") - F.lag("lon").over(W.partitionBy(key).orderBy("lon"))
    g = w.withColumn("gap", gap).groupBy(key).agg(
        F.min("lon").alias("first"), F.max("lon").alias("last"), F.max("gap").alias("gap"),
        F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", -F.col("lon")))).alias("best"),
    )
    wrap = F.col("first") + 360.0 - F.col("last")
    inner = F.coalesce(F.col("gap") > wrap, F.lit(False))
    return g.select(key, F.when(inner, -F.col("best")["col2"]).otherwise(F.col("first")).alias("start"), (360.0 - F.greatest(wrap, F.coalesce("gap", wrap))).alias("length"))


def centre_longitude(arc: DataFrame) -> DataFrame:
    return arc.withColumn("centre", wrap_longitude(F.col("start") + F.col("length") / 2))


def repeated_vertices(vertices: DataFrame) -> DataFrame:
    """(feature, n): vertices equal to the one before them in their ring."""
    same = (F.col("x") == F.lag("x").over(_along())) & (F.col("y") == F.lag("y").over(_along()))
    return vertices.withColumn("same", same).groupBy("feature").agg(F.count_if("same").alias("n")).where("n > 0")


def clean_rings(vertices: DataFrame) -> DataFrame:
    """Rings without repeated vertices, closed, of at least three distinct points; a ring with a non-finite vertex goes."""
    odd = F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    v = vertices.join(vertices.where(odd).select(*RING).distinct(), [*RING], "left_anti")
    fresh = F.coalesce((F.col("x") != F.lag("x").over(_along())) | (F.col("y") != F.lag("y").over(_along())), F.lit(True))
    v = v.withColumn("fresh", fresh).where("fresh").drop("fresh")
    ends = v.groupBy(*RING).agg(
        F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"),
        F.max("pos").alias("last"), F.countDistinct("x", "y").alias("n"),
    ).where("n >= 3")
    kept = v.join(ends.select(*RING), [*RING], "left_semi")
    closing = ends.where("a <> b").select(*RING, (F.col("last") + 1).alias("pos"), "a.x", "a.y")
    return kept.select(*RING, "pos", "x", "y").unionByName(closing)


def unwrap(lons: Column, lon0: float) -> Column:
    """Longitudes of an array, each moved by whole turns next to the one before; the first next to lon0."""
    near = lambda x, ref: x - F.lit(360.0) * F.round((x - ref) / F.lit(360.0))
    start = F.array().cast("array<double>")
    step = lambda acc, x: F.concat(acc, F.array(near(x, F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(float(lon0))))))
    return F.aggregate(lons, start, step)


def ring_area(points: Column) -> Column:
    """Signed shoelace area of an array of (x, y) structs."""
    pairs = F.zip_with(points, F.slice(points, 2, F.size(points)), lambda a, b: F.when(b.isNotNull(), a["x"] * b["y"] - b["x"] * a["y"]).otherwise(0.0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2.0


def runs(rows: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """Gaps and islands: consecutive rows of one kind, as (key, run, kind, n)."""
    w = W.partitionBy(*key).orderBy(*order)
    starts = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    numbered = rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))
    return numbered.groupBy(*key, "run").agg(F.min(kind).alias(kind), F.count(F.lit(1)).alias("n"))


def without_seam(vertices: DataFrame) -> DataFrame:
    """Line pieces left when segments with both ends on +-180 go: adds `piece`; lone vertices go."""
    w = W.partitionBy("feature", "line").orderBy("pos")
    on = F.abs("x") == 180.0
    cut = F.coalesce(on & (F.abs(F.lag("x").over(w)) == 180.0), F.lit(False))
    v = vertices.withColumn("cut", cut.cast("int")).withColumn("piece", F.sum("cut").over(w)).drop("cut")
    n = F.count(F.lit(1)).over(W.partitionBy("feature", "line", "piece"))
    return v.withColumn("n", n).where("n >= 2").drop("n")


def edges(vertices: DataFrame) -> DataFrame:
    """Ring edges (feature, part, ring, pos, x0, y0, x1, y1)."""
    nx, ny = F.lead("x").over(_along()), F.lead("y").over(_along())
    return vertices.select(*RING, "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), nx.alias("x1"), ny.alias("y1")).where("x1 is not null")


def border_edges(edge_rows: DataFrame) -> DataFrame:
    """Undirected edges with the kind of border they are.

    Used once: outline; twice by one feature: internal; by two features: shared.
    """
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    e = edge_rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "feature")
    g = e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses"), F.min("feature").alias("left"), F.max("feature").alias("right"))
    kind = F.when(F.col("uses") == 1, "outline").when(F.col("left") == F.col("right"), "internal").otherwise("shared")
    return g.withColumn("kind", kind)


def parent_borders(shared: DataFrame, parents: DataFrame) -> DataFrame:
    """Shared borders as 'parent' if both sides' parents are known and differ, else 'inner'."""
    p = shared.join(parents.select(F.col("feature").alias("left"), F.col("parent").alias("pa")), "left", "left")
    p = p.join(parents.select(F.col("feature").alias("right"), F.col("parent").alias("pb")), "right", "left")
    return p.withColumn("kind", F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull() & (F.col("pa") != F.col("pb")), "parent").otherwise("inner"))


def open_rings(vertices: DataFrame) -> DataFrame:
    """Closed rings without their last vertex, with n, the index i and both neighbours."""
    last = F.max("pos").over(W.partitionBy(*RING))
    v = vertices.withColumn("last", last).where("pos < last").drop("last")
    v = v.withColumn("i", F.row_number().over(_along()) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*RING)))
    point = F.struct("x", "y")
    whole = _along().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag(point).over(_along()), F.last(point).over(whole))
    after = F.coalesce(F.lead(point).over(_along()), F.first(point).over(whole))
    return v.withColumn("before", before).withColumn("after", after)


def junctions(opened: DataFrame) -> DataFrame:
    """(x, y) of vertices whose unordered pair of neighbours differs between uses."""
    pair = F.struct(F.least("before", "after"), F.greatest("before", "after"))
    g = opened.groupBy("x", "y").agg(F.min(pair).alias("a"), F.max(pair).alias("b"))
    return g.where("a <> b").select("x", "y")


def cut_arcs(opened: DataFrame, at: DataFrame) -> DataFrame:
    """Rings cut at junctions: (feature, part, ring, arc, key): key is the arc in canonical direction.

    A ring without junctions is one arc that starts at its smallest vertex.
    """
    j = opened.join(at.withColumn("cut", F.lit(1)), ["x", "y"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    ring = W.partitionBy(*RING)
    point = F.struct("x", "y")
    j = j.withColumn("cuts", F.sum("cut").over(ring)).withColumn("low", F.min(point).over(ring))
    j = j.withColumn("cut", F.when(F.col("cuts") == 0, (point == F.col("low")).cast("int")).otherwise(F.col("cut")))
    j = j.withColumn("total", F.sum("cut").over(ring)).withColumn("arc", F.sum("cut").over(_along()))
    j = j.withColumn("arc", F.when(F.col("arc") == 0, F.col("total")).otherwise(F.col("arc")))
    first = F.min(F.when(F.col("cut") == 1, F.col("i"))).over(ring)
    j = j.withColumn("turn", F.pmod(F.col("i") - first, F.col("n")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", "x", "y", "after"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    end = F.max_by("after", "turn")
    arcs = j.groupBy(*RING, "arc").agg(body.alias("body"), end.alias("end")).withColumn("points", F.concat("body", F.array("end")))
    return arcs.select(*RING, "arc", F.least("points", F.reverse("points")).alias("key"), (F.col("points") > F.reverse("points")).alias("reversed"))


def topology(arcs: DataFrame) -> DataFrame:
    """Distinct arcs with their uses, owners and border kind."""
    g = arcs.groupBy("key").agg(F.count(F.lit(1)).alias("uses"), F.min("feature").alias("left"), F.max("feature").alias("right"))
    return g.withColumn("kind", F.when(F.col("uses") == 1, "outline").when(F.col("left") == F.col("right"), "internal").otherwise("shared"))


def simplify_arcs(arcs: DataFrame, epsilon: float) -> DataFrame:
    """Visvalingam-Whyatt on each arc (key, points): vertices of triangles under epsilon go, ends stay."""
    schema = "key long, points array<array<double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(points=[simplify(np.array([list(p) for p in x], float), epsilon).tolist() for x in b["points"]])

    return arcs.select("key", "points").mapInPandas(run, schema)


def simplify(p: np.ndarray, epsilon: float) -> np.ndarray:
    import heapq

    n = len(p)
    if n < 3:
        return p
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    area = lambda i: abs(
        (p[i][0] - p[before[i]][0]) * (p[after[i]][1] - p[before[i]][1]) - (p[after[i]][0] - p[before[i]][0]) * (p[i][1] - p[before[i]][1])
    ) / 2
    now = {i: area(i) for i in range(1, n - 1)}
    heap = [(a, i) for i, a in now.items()]
    heapq.heapify(heap)
    while heap:
        a, i = heapq.heappop(heap)
        if now.get(i) != a:
            continue
        if a > epsilon:
            break
        del now[i]
        b, c = before[i], after[i]
        after[b], before[c] = c, b
        for k in (b, c):
            if k in now:
                now[k] = max(a, area(k))
                heapq.heappush(heap, (now[k], k))
    keep = [i for i in range(n) if i in now or i in (0, n - 1)]
    return p[keep]


def issues(features: DataFrame, vertices: DataFrame, parts: DataFrame, overlaps: DataFrame, near: DataFrame,
           invalid: DataFrame | None = None, sliver_area: float = 1e-4, compactness: float = 0.02) -> DataFrame:
    """(feature, kind, detail, other): all findings, each once.

    features: (feature, id, empty); vertices: ring rows; parts: (feature, area, perimeter);
    overlaps: (a, b, share); near: (a, b, n); invalid: (feature, reason).
    """
    rows = lambda df, kind, detail=F.lit(None).cast("string"), other=F.lit(None).cast("string"): df.select(
        F.col("feature"), F.lit(kind).alias("kind"), detail.alias("detail"), other.alias("other")
    )
    full = features.where("not empty")
    n = F.count(F.lit(1)).over(W.partitionBy("id"))
    duplicate = features.withColumn("n", n).where("n > 1")
    bad = F.isnan("x") | F.isnan("y") | (F.abs("x") > 180.0) | (F.abs("y") > 90.0)
    sliver = (F.col("area") < sliver_area) & (F.col("perimeter") > 0) & (12.566370614359172 * F.col("area") / (F.col("perimeter") * F.col("perimeter")) < compactness)
    found = [
        rows(duplicate, "duplicate_id"),
        rows(features.where("empty"), "empty"),
        rows(vertices.where(bad).join(full.select("feature"), "feature", "left_semi"), "out_of_range"),
        rows(repeated_vertices(vertices), "duplicate_points", F.col("n").cast("string")),
        rows(parts.where(sliver), "sliver"),
        rows(overlaps.select(F.col("a").alias("feature"), "b", "share"), "overlap", F.round(F.col("share") * 1000).cast("long").cast("string"), F.col("b").cast("string")),
        rows(near.select(F.col("a").alias("feature"), "b", "n"), "near_miss_border", F.col("n").cast("string"), F.col("b").cast("string")),
    ]
    if invalid is not None:
        found.append(rows(invalid, "invalid", F.col("reason")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def polygon_problem(edge_rows: DataFrame, cell: float) -> DataFrame:
    """(feature, part, reason): rings of fewer than three distinct points; else proper crossings or collinear overlaps of
    edges that are not neighbours.

    Edges meet per grid cell; vertices that only touch are accepted, repeated vertices don't count.
    """
    from .spatial import box_pairs

    few = edge_rows.groupBy(*RING).agg(F.countDistinct("x0", "y0").alias("n")).where("n < 3").select("feature", "part").distinct()
    ring = W.partitionBy(*RING)
    b = edge_rows.where("x0 <> x1 OR y0 <> y1").select(*RING, "x0", "y0", "x1", "y1", F.row_number().over(_along()).alias("at"), F.count(F.lit(1)).over(ring).alias("n"))
    named = b.select(*RING, "at", "n", F.col("x0").alias("px"), F.col("y0").alias("py"), F.col("x1").alias("qx"), F.col("y1").alias("qy"))
    boxed = named.withColumns({"x0": F.least("px", "qx"), "x1": F.greatest("px", "qx"), "y0": F.least("py", "qy"), "y1": F.greatest("py", "qy")})
    pairs = box_pairs(boxed, boxed, cell).where("feature = feature_b and part = part_b").where("struct(ring, at) < struct(ring_b, at_b)")
    pairs = pairs.where("NOT (ring = ring_b AND (at_b = at + 1 OR (at = 1 AND at_b = n)))")
    side = lambda ax, ay, bx, by, cx, cy: (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))
    d1, d2 = side("px", "py", "qx", "qy", "px_b", "py_b"), side("px", "py", "qx", "qy", "qx_b", "qy_b")
    d3, d4 = side("px_b", "py_b", "qx_b", "qy_b", "px", "py"), side("px_b", "py_b", "qx_b", "qy_b", "qx", "qy")
    crossing = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    overlap = (d1 == 0) & (d2 == 0) & (
        (F.least("x1", "x1_b") > F.greatest("x0", "x0_b")) | (F.least("y1", "y1_b") > F.greatest("y0", "y0_b"))
    )
    reason = F.when(crossing, "edges cross").when(overlap, "edges overlap")
    bad = pairs.withColumn("reason", reason).where("reason is not null").select("feature", "part", "reason")
    found = bad.unionByName(few.withColumn("reason", F.lit("a ring of fewer than 3 distinct points")))
    return found.groupBy("feature", "part").agg(F.min("reason").alias("reason"))


def assemble(parts: DataFrame, min_area: float) -> DataFrame:
    """Parts (feature, part, area) that stay: at least min_area, and always each feature's largest."""
    best = parts.groupBy("feature").agg(F.max_by("part", F.struct(F.col("area"), -F.col("part"))).alias("largest"))
    return parts.join(best, "feature").where((F.col("area") >= min_area) | (F.col("part") == F.col("largest"))).drop("largest")
