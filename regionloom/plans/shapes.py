"""Queries of the spatial and ring operators on boxes and polygons made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arcs, dissolve, graph, rings, spatial
from ..session import table
from .registry import query

_BOX_SQL = """
WITH a AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 360 - 180)::DOUBLE AS x0, (s_suppkey * 53 % 160 - 80)::DOUBLE AS y0,
    (s_suppkey * 37 % 360 - 180 + 4 + s_suppkey % 9)::DOUBLE AS x1, (s_suppkey * 53 % 160 - 80 + 3 + s_suppkey % 7)::DOUBLE AS y1 FROM supplier),
b AS (SELECT c_custkey AS id, (c_custkey * 29 % 360 - 180)::DOUBLE AS x0, (c_custkey * 31 % 160 - 80)::DOUBLE AS y0,
    (c_custkey * 29 % 360 - 180 + 3 + c_custkey % 8)::DOUBLE AS x1, (c_custkey * 31 % 160 - 80 + 3 + c_custkey % 6)::DOUBLE AS y1 FROM customer),
"""


def _boxes(spark, sf_dir, name="supplier", key="s_suppkey", m=(37, 53, 4, 9, 3, 7)):
    k = F.col(key)
    x0, y0 = (k * m[0] % 360 - 180).cast("double"), (k * m[1] % 160 - 80).cast("double")
    return table(spark, sf_dir, name).select(
        k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + m[2] + k % m[3]).alias("x1"), (y0 + m[4] + k % m[5]).alias("y1")
    )


def _pairs(spark, sf_dir):
    """Pairs of suppliers' and customers' boxes without repeats, and whose copies all suppliers and customers are."""
    a, of_a = spatial.copies(_boxes(spark, sf_dir), *spatial.BOX)
    b, of_b = spatial.copies(_boxes(spark, sf_dir, "customer", "c_custkey", (29, 31, 3, 8, 3, 6)), *spatial.BOX)
    return spatial.box_pairs(a, b, 12.0), of_a, of_b


_PAIR_SQL = _BOX_SQL + """
p AS (SELECT a.id, b.id AS id_b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS ov,
    (a.x1 - a.x0) * (a.y1 - a.y0) AS ar, (b.x1 - b.x0) * (b.y1 - b.y0) AS br
  FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
"""


@query(_PAIR_SQL + "SELECT id, id_b, ov AS overlap FROM p")
def box_intersections(spark, sf_dir):
    pairs, a, b = _pairs(spark, sf_dir)
    return spatial.of_all(pairs.withColumn("overlap", spatial.box_overlap()), a, b, ("overlap",))


@query(_PAIR_SQL + """SELECT id AS "from", id_b AS "to", round(ov / ar / sum(ov / ar) OVER (PARTITION BY id), 6) AS weight FROM p WHERE ov / ar >= 0.05""")
def overlap_crosswalk_boxes(spark, sf_dir):
    pairs, a, b = _pairs(spark, sf_dir)
    return spatial.crosswalk_of_all(spatial.overlap_crosswalk(pairs, spatial.box_overlap(), spatial.box_area(), 0.05), a, b)


@query(_PAIR_SQL + "SELECT id, arg_min(id_b, id_b - 1e7 * ov) AS id_b, max(ov) AS overlap FROM p WHERE ov / ar >= 0.3 AND ov / br >= 0.3 GROUP BY id")
def best_match_boxes(spark, sf_dir):
    pairs, a, _ = _pairs(spark, sf_dir)
    return spatial.best_of_all(spatial.best_match(pairs, spatial.box_overlap(), spatial.box_area(), spatial.box_area("_b"), 0.3), a)


@query(_BOX_SQL + """
p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))
   / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS share
  FROM a JOIN a b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
SELECT a, b, share FROM p WHERE share > 0.1""")
def overlap_self(spark, sf_dir):
    boxes, all_ = spatial.copies(_boxes(spark, sf_dir), *spatial.BOX)
    pairs = spatial.box_pairs(boxes, boxes, 12.0).where("id <= id_b")
    return spatial.self_overlaps_of_all(pairs, all_, spatial.box_overlap(), spatial.box_area(), spatial.box_area("_b"), 0.1)


def _sheared(*corners):
    """A ring of box corners (u, v) moved by an affine map: x = u + v / 2, y = v + u / 4. Shares of areas stay."""
    return F.array(*[F.array(F.col(u) + F.col(v) / 2 if isinstance(u, str) else u + v / 2, F.col(v) + F.col(u) / 4 if isinstance(u, str) else v + u / 4) for u, v in corners])


def _notched(df):
    """Boxes without their upper right quarter, sheared."""
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    c = F.col
    corners = [(c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), my), (mx, my), (mx, c("y1")), (c("x0"), c("y1"))]
    return df.select("id", F.array(F.array(_sheared(*corners))).alias("geometry"))


def _holed(df):
    """Boxes with a hole of half their width and height in their middle, sheared."""
    c = F.col
    q = lambda a, b, k: c(a) + (c(b) - c(a)) * k / 4
    outer = _sheared(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))
    inner = _sheared(*((q("x0", "x1", i), q("y0", "y1", j)) for i, j in ((1, 1), (1, 3), (3, 3), (3, 1))))
    return df.select("id", F.array(F.array(outer, inner)).alias("geometry"))


def _measured(shapes):
    """Shapes without repeats, with their boxes and areas, stored: once a shape, not once a pair and use; and all shapes' copies."""
    one, all_ = spatial.copies(shapes, "geometry")
    return graph.cut(one.withColumns(spatial.polygon_box("geometry") | {"area": spatial.polygon_area("geometry")})), all_


def _shape_pairs(spark, sf_dir):
    """Pairs of notched suppliers and holed customers (without repeats) whose boxes meet, with the area of their intersection and
    their own, and the copies.
    """
    a = _notched(_boxes(spark, sf_dir))
    b = _holed(_boxes(spark, sf_dir, "customer", "c_custkey", (29, 31, 3, 8, 3, 6)))
    (a, of_a), (b, of_b) = (_measured(x) for x in (a, b))
    pairs = spatial.dealt(spatial.box_pairs(a, b, 8.0)).withColumn("overlap", spatial.intersection_area("geometry", "geometry_b"))
    return pairs, of_a, of_b


#: In the plane before the map: what the boxes share, less the part in the notch, less the parts in the hole outside the notch.
_SHAPE_SQL = _BOX_SQL.rstrip().rstrip(",") + """,
m AS (SELECT a.id, b.id AS id_b, a.x0, a.y0, a.x1, a.y1, (a.x0 + a.x1) / 2 AS nx, (a.y0 + a.y1) / 2 AS ny, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
  b.x0 + (b.x1 - b.x0) / 4 AS hx0, b.y0 + (b.y1 - b.y0) / 4 AS hy0, b.x1 - (b.x1 - b.x0) / 4 AS hx1, b.y1 - (b.y1 - b.y0) / 4 AS hy1
  FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
p AS (SELECT id, id_b,
  greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1, by1) - greatest(y0, by0))
  - greatest(0, least(x1, bx1) - greatest(nx, bx0)) * greatest(0, least(y1, by1) - greatest(ny, by0))
  - greatest(0, least(x1, hx1) - greatest(x0, hx0)) * greatest(0, least(y1, hy1) - greatest(y0, hy0))
  + greatest(0, least(x1, hx1) - greatest(nx, hx0)) * greatest(0, least(y1, hy1) - greatest(ny, hy0)) AS ov,
  (x1 - x0) * (y1 - y0) * 0.75 AS ar, (bx1 - bx0) * (by1 - by0) * 0.75 AS br FROM m)
"""


@query(_SHAPE_SQL + """SELECT id AS "from", id_b AS "to", round(ov / ar / sum(ov / ar) OVER (PARTITION BY id), 6) AS weight FROM p WHERE ov / ar >= 0.0501""")
def overlap_crosswalk_polygons(spark, sf_dir):
    """Areal weights of concave shapes against shapes with holes."""
    pairs, a, b = _shape_pairs(spark, sf_dir)
    return spatial.crosswalk_of_all(spatial.overlap_crosswalk(pairs, F.col("overlap"), F.col("area"), 0.0501), a, b)


@query(_SHAPE_SQL + "SELECT id, arg_min(id_b, id_b - 1e7 * round(ov, 6)) AS id_b, round(max(ov), 6) AS overlap FROM p WHERE ov / ar >= 0.2001 AND ov / br >= 0.2001 GROUP BY id")
def best_match_polygons(spark, sf_dir):
    p, a, _ = _shape_pairs(spark, sf_dir)
    det = 1 - 1 / 8  # of the map
    return spatial.best_of_all(spatial.best_match(p, F.round(F.col("overlap") / det, 6), F.col("area") / det, F.col("area_b") / det, 0.2001), a)


@query(_BOX_SQL.rstrip().rstrip(",") + """,
m AS (SELECT a.id AS a, b.id AS b, a.x0, a.y0, a.x1, a.y1, (a.x0 + a.x1) / 2 AS nx, (a.y0 + a.y1) / 2 AS ny, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, (b.x0 + b.x1) / 2 AS mx, (b.y0 + b.y1) / 2 AS my
  FROM b a JOIN b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
p AS (SELECT a, b,
  (greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1, by1) - greatest(y0, by0))
  - greatest(0, least(x1, bx1) - greatest(nx, bx0)) * greatest(0, least(y1, by1) - greatest(ny, by0))
  - greatest(0, least(x1, bx1) - greatest(x0, mx)) * greatest(0, least(y1, by1) - greatest(y0, my))
  + greatest(0, least(x1, bx1) - greatest(nx, mx)) * greatest(0, least(y1, by1) - greatest(ny, my)))
  / (0.75 * least((x1 - x0) * (y1 - y0), (bx1 - bx0) * (by1 - by0))) AS share FROM m)
SELECT a, b, round(share, 6) AS share FROM p WHERE share > 0.1001""")
def overlap_self_polygons(spark, sf_dir):
    """Concave shapes of one layer that overlap."""
    a, all_ = _measured(_notched(_boxes(spark, sf_dir, "customer", "c_custkey", (29, 31, 3, 8, 3, 6))))
    p = spatial.dealt(spatial.box_pairs(a, a, 8.0).where("id <= id_b")).withColumn("overlap", spatial.intersection_area("geometry", "geometry_b"))
    return spatial.self_overlaps_of_all(p, all_, F.col("overlap"), F.col("area"), F.col("area_b"), 0.1001, 6)


_CELLS_SQL = """
WITH c AS (SELECT DISTINCT p_brand, p_partkey * 7 % 43 AS x, p_partkey * 11 % 37 AS y FROM part),
n AS (SELECT c.*, EXISTS (FROM c r WHERE r.p_brand = c.p_brand AND r.x = c.x + 1 AND r.y = c.y) AS e, EXISTS (FROM c u WHERE u.p_brand = c.p_brand AND u.x = c.x AND u.y = c.y + 1) AS o,
             EXISTS (FROM c d WHERE d.p_brand = c.p_brand AND d.x = c.x + 1 AND d.y = c.y + 1) AS d, EXISTS (FROM c w JOIN c v ON v.p_brand = w.p_brand AND v.x = w.x AND v.y = w.y + 1 WHERE w.p_brand = c.p_brand AND w.x = c.x + 1 AND w.y = c.y) AS col FROM c)
"""


@query(_CELLS_SQL + """
SELECT p_brand AS code, (SELECT arg_min(p_type, p_partkey) FROM part q WHERE q.p_brand = n.p_brand) AS parent, count(*)::DOUBLE AS area,
  (count(*) - count(*) FILTER (e) - count(*) FILTER (o) + count(*) FILTER (o AND col))::INT AS parts_less_holes,
  (4 * count(*) - 2 * count(*) FILTER (e) - 2 * count(*) FILTER (o))::DOUBLE AS length
FROM n GROUP BY p_brand""")
def dissolved_references(spark, sf_dir):
    """Parts as squares of a grid, united by brand: area, length of all borders, and by Euler's formula parts less holes."""
    k = F.col("p_partkey")
    x, y = (k * 7 % 43).cast("double"), (k * 11 % 37).cast("double")
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    square = F.array(F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))))
    parts = table(spark, sf_dir, "part").select(k.alias("pos"), "p_brand", "p_type", square.alias("geometry"))
    united = dissolve.grouped_references(parts, F.col("p_brand"), F.col("p_type"))
    found = united.withColumns(dissolve.ring_counts("geometry"))
    return found.select("code", "parent", spatial.polygon_area("geometry").alias("area"), (F.col("parts") - F.col("holes")).alias("parts_less_holes"), "length")


@query(_BOX_SQL + "w AS (SELECT 1) SELECT id FROM a WHERE x1 >= -20 AND x0 <= 35 AND y1 >= -10 AND y0 <= 50")
def features_in_box(spark, sf_dir):
    return _boxes(spark, sf_dir).where(spatial.in_box(-20.0, -10.0, 35.0, 50.0)).select("id")


@query(_BOX_SQL + """
pt AS (SELECT c_custkey AS pid, (c_custkey * 17 % 3600) / 10.0::DOUBLE - 180.05 AS x, (c_custkey * 13 % 1600) / 10.0::DOUBLE - 80.05 AS y FROM customer)
SELECT pid, id FROM pt JOIN a ON x > x0 AND x < x1 AND y > y0 AND y < y1""")
def points_in_polygons(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("pid"), ((k * 17 % 3600) / 10.0 - 180.05).alias("x"), ((k * 13 % 1600) / 10.0 - 80.05).alias("y"))
    e = lambda a, b, c, d: F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1"))
    edges = F.array(e("x0", "y0", "x1", "y0"), e("x1", "y0", "x1", "y1"), e("x1", "y1", "x0", "y1"), e("x0", "y1", "x0", "y0"))
    return spatial.points_in_polygons(points, _boxes(spark, sf_dir).withColumn("edges", edges), 12.0)


_GAP = """greatest(b.y0 - a.y1, a.y0 - b.y1, 0) * 111.2"""
_CLUSTER = """
WITH RECURSIVE a AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey * 67 % 350 - 175)::DOUBLE AS x0, (n_nationkey * 41 % 130 - 65)::DOUBLE AS y0,
    (n_nationkey * 67 % 350 - 173)::DOUBLE AS x1, (n_nationkey * 41 % 130 - 62)::DOUBLE AS y1 FROM nation),
g AS (SELECT a.id AS u, b.id AS v, greatest(b.y0 - a.y1, a.y0 - b.y1, 0) * 111.2 AS dy,
   least(greatest(b.x0 - 360 - a.x1, a.x0 - b.x1 + 360, 0), greatest(b.x0 - a.x1, a.x0 - b.x1, 0), greatest(b.x0 + 360 - a.x1, a.x0 - b.x1 - 360, 0))
     * 111.2 * greatest(abs(cos(radians((a.y0 + a.y1 + b.y0 + b.y1) / 4))), 0.05) AS dx
  FROM a JOIN a b ON a.id <> b.id),
e AS (SELECT u, v FROM g WHERE sqrt(dx * dx + dy * dy) <= 3000),
reach AS (SELECT id AS node, id AS r FROM a UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.node),
comp AS (SELECT node, min(r) AS component FROM reach GROUP BY node)
"""


def _clusters(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    x, y = (k * 67 % 350 - 175).cast("double"), (k * 41 % 130 - 65).cast("double")
    boxes = table(spark, sf_dir, "nation").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 2).alias("x1"), (y + 3).alias("y1"))
    return boxes, graph.components(spatial.cluster_edges(boxes, 3000.0))


@query(_CLUSTER + "SELECT node, component FROM comp WHERE node IN (SELECT u FROM e)")
def cluster_components(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


_WEIGHTS = _CLUSTER + """, w AS (SELECT component, sum((x1 - x0) * (y1 - y0) * abs(cos(radians((y0 + y1) / 2)))) AS weight, list(id ORDER BY id) AS members
  FROM a JOIN comp ON a.id = comp.node GROUP BY component)
"""


@query(_WEIGHTS + "SELECT component, round(weight, 6) AS weight, members FROM w")
def cluster_weights(spark, sf_dir):
    return graph.cluster_weights(*_clusters(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(_WEIGHTS + """, o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, component) AS r, max(weight) OVER () AS main FROM w)
SELECT component, round(weight, 6) AS weight FROM o WHERE r > 1 AND weight >= main * 2.5e-4 ORDER BY weight DESC, component LIMIT 3""")
def cluster_insets(spark, sf_dir):
    return graph.top_clusters(graph.cluster_weights(*_clusters(spark, sf_dir)), 3).withColumn("weight", F.round("weight", 6))


@query("""
WITH l AS (SELECT DISTINCT s_nationkey AS k, ((s_suppkey * 97 % 720) / 2.0::DOUBLE + 360) % 360 - 180 AS lon FROM supplier),
g AS (SELECT *, lon - lag(lon) OVER (PARTITION BY k ORDER BY lon) AS gap FROM l),
s AS (SELECT k, min(lon) AS first, max(lon) AS last, max(gap) AS gap, arg_max(lon, gap * 1000 - lon / 1000) FILTER (gap IS NOT NULL) AS at_lon FROM g GROUP BY k)
SELECT k AS s_nationkey, CASE WHEN coalesce(gap, -1) > first + 360 - last THEN at_lon ELSE first END AS start,
  360 - greatest(first + 360 - last, coalesce(gap, 0)) AS length FROM s""")
def covering_arc(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", ((F.col("s_suppkey") * 97 % 720) / 2.0 - 540.0).alias("lon"))
    return rings.covering_arc(s, "s_nationkey", "lon")


@query("""
WITH r AS (SELECT *, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM n GROUP BY user_id, run""")
def border_runs(spark, sf_dir):
    return rings.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


def _squares(spark, sf_dir):
    """Ring rows of unit squares on a grid; a feature is a nation."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return n.select(k.cast("long").alias("feature"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.posexplode(ring).alias("pos", "p")).select("feature", "part", "ring", "pos", "p.x", "p.y")


_EDGES = """
WITH q AS (SELECT n_nationkey AS f, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation),
e AS (SELECT f, x AS ax, y AS ay, x + 1 AS bx, y AS by_ FROM q UNION ALL SELECT f, x + 1, y, x + 1, y + 1 FROM q
  UNION ALL SELECT f, x, y + 1, x + 1, y + 1 FROM q UNION ALL SELECT f, x, y, x, y + 1 FROM q),
g AS (SELECT ax, ay, bx, by_, count(*) AS uses, min(f)::BIGINT AS l, max(f)::BIGINT AS r FROM e GROUP BY ALL)
"""


@query(_EDGES + "SELECT CASE WHEN uses = 1 THEN 'outline' ELSE 'shared' END AS kind, count(*) AS n FROM g GROUP BY 1")
def border_kinds(spark, sf_dir):
    return rings.border_edges(rings.edges(_squares(spark, sf_dir))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_EDGES + "SELECT ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, by_::DOUBLE AS by_, l AS owner FROM g WHERE uses = 1")
def outline_edges(spark, sf_dir):
    b = rings.border_edges(rings.edges(_squares(spark, sf_dir))).where("kind = 'outline'")
    return b.select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_"), F.col("left").alias("owner"))


@query(_EDGES + """SELECT l AS "left", r AS "right", CASE WHEN a.n_regionkey <> b.n_regionkey THEN 'parent' ELSE 'inner' END AS kind
FROM g JOIN nation a ON a.n_nationkey = l JOIN nation b ON b.n_nationkey = r WHERE uses = 2""")
def parent_borders(spark, sf_dir):
    shared = rings.border_edges(rings.edges(_squares(spark, sf_dir))).where("kind = 'shared'")
    parents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("feature"), F.col("n_regionkey").cast("string").alias("parent"))
    return rings.parent_borders(shared, parents).select("left", "right", "kind")


@query("""
SELECT x::DOUBLE AS x, y::DOUBLE AS y FROM range(6) a(x), range(6) b(y) WHERE (x > 0 AND x < 5) OR (y > 0 AND y < 5)""")
def junction_vertices(spark, sf_dir):
    """On a 5 by 5 grid of squares all vertices but the four corners join several outlines."""
    return rings.junctions(rings.open_rings(_squares(spark, sf_dir)))


@query(_EDGES + """,
v AS (SELECT ax AS x, ay AS y FROM e UNION ALL SELECT bx, by_ FROM e),
once AS (SELECT x, y FROM v GROUP BY x, y HAVING count(*) = 2)
SELECT 'outline' AS kind, count(*) FILTER (uses = 1) - (SELECT count(*) FROM once) AS arcs, (SELECT count(*) FROM once) AS longer FROM g
UNION ALL SELECT 'shared', count(*) FILTER (uses = 2), 0 FROM g""")
def topology_arcs(spark, sf_dir):
    """Arcs between junctions: a corner of one square alone lies inside an outline arc of two edges."""
    opened = rings.open_rings(_squares(spark, sf_dir))
    t = rings.topology(rings.cut_arcs(opened, rings.junctions(opened)))
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("arcs"), F.count_if(F.size("key") > 2).alias("longer"))


@query("SELECT n_nationkey::BIGINT AS feature, ((1 + n_nationkey % 4) ** 2 * CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS area FROM nation")
def ring_areas(spark, sf_dir):
    """Squares of four sizes, walked left and right about."""
    scale = 1 + F.col("feature") % 4
    along = F.when(F.col("feature") % 2 == 0, F.col("pos")).otherwise(-F.col("pos"))
    v = _squares(spark, sf_dir).select("feature", "part", "ring", along.alias("pos"), (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))
    g = v.groupBy("feature", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return g.select("feature", rings.ring_area(F.col("p")).alias("area"))


_ISSUES = """
WITH f AS (SELECT s_suppkey AS feature, CASE WHEN s_suppkey % 10 = 0 THEN 'same' ELSE 'S' || s_suppkey END AS id, s_suppkey % 7 = 0 AS empty,
    CASE WHEN s_suppkey % 11 = 0 THEN 181.0::DOUBLE ELSE 1.0 END AS x FROM supplier),
i AS (SELECT 'duplicate_id' AS kind, feature FROM f WHERE (SELECT count(*) FROM f g WHERE g.id = f.id) > 1
  UNION ALL SELECT 'empty', feature FROM f WHERE empty UNION ALL SELECT 'out_of_range', feature FROM f WHERE NOT empty AND x > 180
  UNION ALL SELECT 'duplicate_points', feature FROM f WHERE feature % 13 = 0 UNION ALL SELECT 'sliver', feature FROM f WHERE feature % 17 = 0
  UNION ALL SELECT 'overlap', feature FROM f WHERE feature % 19 = 0 UNION ALL SELECT 'near_miss_border', feature FROM f WHERE feature % 23 = 0)
"""


def _issues(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    f = s.select(k.alias("feature"), F.when(k % 10 == 0, "same").otherwise(F.concat(F.lit("S"), k.cast("string"))).alias("id"), (k % 7 == 0).alias("empty"))
    x = F.when(k % 11 == 0, 181.0).otherwise(1.0)
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    ring = F.when(k % 13 == 0, F.array(point(x, F.lit(0.0)), point(x, F.lit(0.0)))).otherwise(F.array(point(x, F.lit(0.0)), point(F.lit(2.0), F.lit(1.0))))
    v = s.select(k.alias("feature"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.posexplode(ring).alias("pos", "p")).select("feature", "part", "ring", "pos", "p.x", "p.y")
    thin = k % 17 == 0
    parts = s.select(k.alias("feature"), F.when(thin, 5e-5).otherwise(1.0).alias("area"), F.when(thin, 2.0).otherwise(4.0).alias("perimeter"))
    overlaps = s.where(k % 19 == 0).select(k.alias("a"), (k + 1).alias("b"), F.lit(0.5).alias("share"))
    near = s.where(k % 23 == 0).select(k.alias("a"), (k + 2).alias("b"), F.lit(3).cast("long").alias("n"))
    return rings.issues(f, v, parts, overlaps, near)


@query(_ISSUES + "SELECT kind, count(*) AS n FROM i GROUP BY kind")
def issue_counts(spark, sf_dir):
    return _issues(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _odd_shapes(spark, sf_dir):
    """By supplier a square, a bow tie, a ring there and back, or a square with a hole that crosses its edge."""
    k = F.col("s_suppkey")
    x, y = (k % 50 * 10).cast("double"), (F.floor(k / 50) * 10).cast("double")
    ring = lambda *at: F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in at))
    square = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    outer = F.when(k % 4 == 0, square).when(k % 4 == 1, ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))).when(k % 4 == 2, ring((0, 0), (1, 0), (0, 0))).otherwise(ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)))
    holes = F.when(k % 4 == 3, F.array(ring((3, 1), (5, 1), (5, 2), (3, 2), (3, 1)))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("feature"), F.lit(0).alias("part"), F.posexplode(F.concat(F.array(outer), holes)).alias("ring", "points"))
    return rows.select("feature", "part", "ring", F.posexplode("points").alias("pos", "p")).select("feature", "part", "ring", "pos", "p.x", "p.y")


@query("""SELECT s_suppkey AS feature, 0 AS part, CASE s_suppkey % 4 WHEN 2 THEN 'a ring of fewer than 3 distinct points' ELSE 'edges cross' END AS reason
FROM supplier WHERE s_suppkey % 4 <> 0""")
def polygon_validity(spark, sf_dir):
    return rings.polygon_problem(rings.edges(_odd_shapes(spark, sf_dir)), 1.0)


@query("""
WITH p AS (SELECT c_custkey AS pid, (c_custkey % 100)::DOUBLE + 0.25 AS x, CASE WHEN c_custkey % 3 = 0 THEN 0.125 ELSE 3.0 END::DOUBLE AS y FROM customer)
SELECT pid, x, CASE WHEN y = 0.125 THEN 0.0 ELSE y END::DOUBLE AS y FROM p""")
def snap_to_outline(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("pid"), ((k % 100) + 0.25).cast("double").alias("x"), F.when(k % 3 == 0, 0.125).otherwise(3.0).alias("y"))
    segments = spark.range(0, 110, 10).select(F.col("id").alias("sid"), F.col("id").cast("double").alias("ax"), F.lit(0.0).alias("ay"), (F.col("id") + 10).cast("double").alias("bx"), F.lit(0.0).alias("by"))
    return spatial.snap_onto(points, segments, 0.25).select("pid", "x", "y")


@query("""
WITH p AS (SELECT s_suppkey AS pid, (s_suppkey % 20)::BIGINT AS owner FROM supplier)
SELECT owner AS a, 1000::BIGINT AS b, count(*) AS n FROM p WHERE pid % 2 = 0 GROUP BY owner""")
def near_miss_borders(spark, sf_dir):
    """Even vertices lie just above another owner's line, odd ones on it."""
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(k.alias("pid"), (k % 20).alias("owner"), (k % 90).cast("double").alias("x"), F.when(k % 2 == 0, 0.001).otherwise(0.0).alias("y"))
    line = spark.range(0, 100).select(F.lit(1000).cast("long").alias("owner"), F.col("id").alias("sid"), F.col("id").cast("double").alias("ax"), F.lit(0.0).alias("ay"), (F.col("id") + 1).cast("double").alias("bx"), F.lit(0.0).alias("by"))
    return spatial.near_misses(v, line, 0.01)


@query()
def simplify_arcs(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(k.cast("long").alias("key"), F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.array(i.cast("double"), F.sin(i.cast("double") * (k + 1) / 7.0))).alias("points"))
    return rings.simplify_arcs(n, 0.2)


#: Squares on a grid of five a row; the middle of the border to the right neighbour is moved to the right by d.
_TEETH_SQL = """
WITH n AS (SELECT n_nationkey::BIGINT AS k, n_nationkey % 5 AS x, CASE WHEN n_nationkey % 5 < 4 THEN 0.025::DOUBLE * (n_nationkey % 7) ELSE 0 END AS d FROM nation),
t AS (SELECT *, CASE WHEN d / 2 > 0.03 THEN d ELSE 0 END AS kept FROM n)
"""


def _toothed(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    tooth = lambda c: F.when(c % 5 < 4, (c % 7) * 0.025).otherwise(0.0)
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    west = F.when(k % 5 > 0, tooth(k - 1)).otherwise(0.0)
    ring = F.array(at(0, 0), at(1, 0), at(tooth(k) + 1, 0.5), at(1, 1), at(0, 1), at(west, 0.5), at(0, 0))
    n = table(spark, sf_dir, "nation").select(k.alias("feature"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.posexplode(ring).alias("pos", "p"))
    return n.select("feature", "part", "ring", "pos", "p.x", "p.y")


@query(_TEETH_SQL + """
SELECT t.k AS feature, round(1 + t.kept / 2 - coalesce(w.kept, 0) / 2, 9) AS area, 5 + (t.kept > 0)::INT + (coalesce(w.kept, 0) > 0)::INT AS points
FROM t LEFT JOIN t w ON w.k = t.k - 1 AND t.x > 0""")
def simplified_shapes(spark, sf_dir):
    """Teeth under the threshold go from both sides of their border, the others stay on both."""
    shapes, _ = arcs.simplify_shared(_toothed(spark, sf_dir), 0.03)
    return shapes.select("feature", F.round(arcs.shape_area("geometry"), 9).alias("area"), F.size(F.flatten(F.flatten("geometry"))).alias("points"))


@query(_TEETH_SQL + """
SELECT k AS a, k + 1 AS b, round(CASE WHEN kept > 0 THEN 2 * sqrt(0.25 + kept * kept) ELSE 1 END, 9) AS length FROM t WHERE x < 4
UNION ALL SELECT k, k + 5, 1.0 FROM t WHERE k < 20
UNION ALL SELECT k, NULL, ((x = 0)::INT + (x = 4)::INT + (k < 5)::INT + (k >= 20)::INT)::DOUBLE FROM t WHERE x IN (0, 4) OR k < 5 OR k >= 20""")
def simplified_borders(spark, sf_dir):
    """Length of the border of each pair of neighbours, and of each outline."""
    _, borders = arcs.simplify_shared(_toothed(spark, sf_dir), 0.03)
    return borders.groupBy("a", "b").agg(F.round(F.sum(arcs.line_length("line")), 9).alias("length"))
