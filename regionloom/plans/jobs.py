"""Queries of the composite jobs: batches, listings, selections, names, provenance, bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import arcs, clip, coast, frame, layout, naming, rings, seam, snap, spatial
from ..session import table
from .registry import query
from .shapes import _BOX_SQL, _WEIGHTS, _boxes, _clusters, _odd_shapes, _squares


def output_name(stem, code, multi, single_region):
    """A job's file name: code, stem, or both when many files have many regions."""
    both = F.concat(stem, F.lit("-"), code)
    return S.file_safe(F.when(code.isNull(), stem).when(~multi, code).when(single_region, stem).otherwise(both))


def duplicate_stems(paths: DataFrame) -> DataFrame:
    """Stems that several input paths share; licence sidecars do not count."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    return paths.where(~F.col("path").endswith(".license.json")).groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def truncated(values, most: int):
    """The first values and how many more there are."""
    more = F.when(F.size(values) > most, F.concat(F.lit(" and "), (F.size(values) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), more)


@query("""
WITH RECURSIVE r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '-2' WHEN 2 THEN p_brand || '-' || p_partkey % 7 ELSE p_size || ' ' || p_type END AS raw FROM part),
p AS (SELECT p_partkey, regexp_replace(raw, '[^A-Za-z0-9_.-]', '_', 'g') AS c FROM r),
n AS (SELECT p_partkey, CASE WHEN regexp_matches(c, '^[A-Za-z_]') THEN c ELSE 'id-' || c END AS id FROM p),
f AS (SELECT *, regexp_replace(id, '(-[0-9]+)+$', '') AS stem, row_number() OVER (PARTITION BY regexp_replace(id, '(-[0-9]+)+$', '') ORDER BY p_partkey) AS i FROM n),
step AS (
  SELECT stem, i, p_partkey, id AS xml_id, [id] AS used FROM f WHERE i = 1
  UNION ALL
  SELECT stem, i, p_partkey, xml_id, list_append(used, xml_id) FROM (
    SELECT f.stem, f.i, f.p_partkey, s.used, list_filter(list_transform(range(1, len(s.used) + 2), lambda k: CASE WHEN k = 1 THEN f.id ELSE f.id || '-' || k END), lambda x: NOT list_contains(s.used, x))[1] AS xml_id
    FROM step s JOIN f ON f.stem = s.stem AND f.i = s.i + 1))
SELECT p_partkey, xml_id FROM step""")
def unique_xml_ids(spark, sf_dir):
    """Ids with numbers at their end among them, so that a numbered repeat meets an id that is really there."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    raw = F.when(k % 4 == 0, brand).when(k % 4 == 1, F.concat(brand, F.lit("-2"))).when(k % 4 == 2, F.concat_ws("-", brand, (k % 7).cast("string")))
    p = table(spark, sf_dir, "part").withColumn("raw", raw.otherwise(F.concat_ws(" ", F.col("p_size").cast("string"), "p_type")))
    return naming.unique_ids(p, "raw", "p_partkey").select("p_partkey", "xml_id")


@query("""
SELECT s_suppkey, regexp_replace(CASE WHEN s_nationkey % 5 = 0 THEN s_name WHEN s_nationkey % 2 = 0 THEN 'N ' || s_nationkey
  WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || '-N ' || s_nationkey END, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM supplier""")
def output_names(spark, sf_dir):
    k = F.col("s_nationkey")
    code = F.when(k % 5 != 0, F.concat(F.lit("N "), k.cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", output_name(F.col("s_name"), code, k % 2 != 0, F.col("s_suppkey") % 3 == 0).alias("name"))


@query("""
WITH p AS (SELECT 'in/' || (s_nationkey % 9) || '.geojson' AS path FROM supplier UNION ALL SELECT 'x/' || s_nationkey || '.gpkg' FROM supplier)
SELECT regexp_extract(path, '/([^.]+)', 1) AS stem, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1""")
def duplicate_input_stems(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.concat(F.lit("in/"), (F.col("s_nationkey") % 9).cast("string"), F.lit(".geojson")).alias("path"))
    b = s.select(F.concat(F.lit("x/"), F.col("s_nationkey").cast("string"), F.lit(".gpkg")).alias("path"))
    c = s.select(F.concat(F.lit("in/a"), F.lit(".license.json")).alias("path"))
    return duplicate_stems(a.unionByName(b).unionByName(c))


@query("""
SELECT r_name AS region, array_to_string(list(n_name ORDER BY n_name)[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS text
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def truncated_warnings(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy(F.col("r_name").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return g.select("region", truncated(F.col("names"), 3).alias("text"))


@query(_BOX_SQL + """w AS (SELECT 1),
c AS (SELECT id, greatest(x0, -60) AS x0, greatest(y0, -30) AS y0, least(x1, 60) AS x1, least(y1, 30) AS y1 FROM a WHERE x1 >= -60 AND x0 <= 60 AND y1 >= -30 AND y0 <= 30)
SELECT id, (x1 - x0) * (y1 - y0) AS area FROM c WHERE x1 > x0 AND y1 > y0""")
def clipped_polygons(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    c = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(c("x0", "y0"), c("x1", "y0"), c("x1", "y1"), c("x0", "y1"), c("x0", "y0"))
    cut = clip.clip_polygons(b.select("id", F.array(F.array(ring)).alias("geometry")), (-60.0, -30.0, 60.0, 30.0))
    return cut.select("id", spatial.polygon_area("geometry").alias("area")).where("area > 0")


@query(_BOX_SQL + """w AS (SELECT 1)
SELECT id, greatest(x0, -60) AS ax, y0 AS ay, least(x1, 60) AS bx FROM a WHERE y0 BETWEEN -30 AND 30 AND x1 >= -60 AND x0 <= 60""")
def clipped_segments(spark, sf_dir):
    s = _boxes(spark, sf_dir).select("id", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y0").alias("by"))
    return clip.clip_segments(s, (-60.0, -30.0, 60.0, 30.0)).select("id", "ax", "ay", "bx")


@query("""
WITH n AS (SELECT n_nationkey::BIGINT AS id, (150 + n_nationkey)::DOUBLE AS w, (-150 - n_nationkey % 7)::DOUBLE AS e, (10 + n_nationkey % 5)::DOUBLE AS h, 4 - n_nationkey % 4 AS d FROM nation)
SELECT id, w AS west, 180.0::DOUBLE AS east, 2 - (w > 168)::INT AS rings, (180 - w) * h - 2 * d - CASE WHEN w > 168 THEN 0 ELSE 4 END AS area FROM n
UNION ALL SELECT id, -180, e, 1, (e + 180) * h - 3 * d FROM n""")
def seam_split(spark, sf_dir):
    """Boxes over the seam with a hole on it, of different width on either side, and for some one west of it."""
    k = F.col("n_nationkey")
    box = lambda w, e, s, n: F.array(*[F.array((x + F.lit(0.0)).cast("double"), (y + F.lit(0.0)).cast("double")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    on = box(F.lit(178), F.lit(-177), F.lit(1), 5 - k % 4)
    rings_ = F.concat(F.array(box(150 + k, -150 - k % 7, F.lit(0), 10 + k % 5), on), F.when(150 + k <= 168, F.array(box(F.lit(170), F.lit(172), F.lit(2), F.lit(4)))).otherwise(F.array().cast("array<array<array<double>>>")))
    cut = seam.split_at_seam(table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), F.array(rings_).alias("geometry")), 0.0)
    parts = cut.select("id", F.explode("geometry").alias("part")).withColumn("shape", F.array("part"))
    xs = F.transform(F.col("part")[0], lambda q: q[0])
    return parts.select("id", F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.size("part").alias("rings"), F.round(spatial.polygon_area("shape"), 9).alias("area"))


@query("""
WITH n AS (SELECT n_nationkey::BIGINT AS id, (170 - n_nationkey)::DOUBLE AS w, (-160 + n_nationkey)::DOUBLE AS e FROM nation)
SELECT id, 0 AS piece, w AS first_x, 180.0::DOUBLE AS last_x, 0.0::DOUBLE AS first_y, 180 - w AS last_y FROM n UNION ALL SELECT id, 1, -180, e, 180 - w, e + 360 - w FROM n""")
def seam_lines(spark, sf_dir):
    """Diagonals over the seam in two pieces that meet at the latitude where they cross it."""
    k = F.col("n_nationkey").cast("double")
    w, e = 170 - k, -160 + k
    line = F.array(F.array(w, F.lit(0.0)), F.array(e, e + 360 - w))
    cut = seam.split_lines_at_seam(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), line.alias("points")), 0.0)
    end = lambda i, c: F.round(F.element_at("points", i)[c], 9)
    return cut.select("id", "piece", end(1, 0).alias("first_x"), end(-1, 0).alias("last_x"), end(1, 1).alias("first_y"), end(-1, 1).alias("last_y"))


@query("""
WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y, n_nationkey % 3 = 0 AS subject FROM nation),
s(pos, dx, dy) AS (VALUES (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)),
e AS (SELECT n.k, pos, EXISTS (FROM n o WHERE o.x = n.x + dx AND o.y = n.y + dy AND NOT o.subject) AS land FROM n, s WHERE n.subject),
r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY pos) AS run FROM (SELECT *, coalesce((land <> lag(land) OVER (PARTITION BY k ORDER BY pos))::INT, 1) AS new FROM e))
SELECT k::BIGINT AS line, run::INT AS run, CASE WHEN land THEN 'external' ELSE 'coast' END AS kind, count(*)::INT + 1 AS points FROM r GROUP BY k, run, land""")
def coast_runs(spark, sf_dir):
    """Every third square of a grid as subject: its sides are borders where another square lies."""
    v = _squares(spark, sf_dir)
    lines = v.where("feature % 3 = 0").select(F.col("feature").alias("line"), "pos", "x", "y", F.lit(True).alias("interior_left"))
    box = v.where("feature % 3 <> 0").groupBy(F.col("feature").alias("id")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    e = lambda a, b, c, d: F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1"))
    edges = F.array(e("x0", "y0", "x1", "y0"), e("x1", "y0", "x1", "y1"), e("x1", "y1", "x0", "y1"), e("x0", "y1", "x0", "y0"))
    runs = coast.outline_runs(lines, box.withColumn("edges", edges), 0.25, 0.5)
    return runs.select("line", "run", "kind", F.size("points").alias("points"))


_MAIN = _WEIGHTS + ", o AS (SELECT component FROM w ORDER BY weight DESC, component LIMIT 1), k AS (SELECT a.* FROM a JOIN comp ON node = id WHERE component = (FROM o))"


def _parts(spark, sf_dir):
    """Nations' boxes as parts; a region's parts are one feature."""
    boxes = _clusters(spark, sf_dir)[0].withColumnRenamed("id", "part")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("part"), F.col("n_regionkey").cast("long").alias("feature"))
    at = F.row_number().over(W.partitionBy("feature").orderBy("part")) - 1
    return boxes.join(n.withColumn("at", at), "part")


@query(_MAIN + """SELECT n_regionkey::BIGINT AS feature, count(*)::INT AS parts, sum(id)::DOUBLE AS keys FROM k JOIN nation ON n_nationkey = id GROUP BY 1""")
def framed_features(spark, sf_dir):
    """Features cut down to their parts in the main cluster."""
    parts = _parts(spark, sf_dir)
    ring = lambda p: F.array(F.array(F.array(p.cast("double"), F.lit(0.0))))
    features = parts.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list("part")), ring).alias("geometry"))
    cut = frame.framed(features, parts, 3000.0)[0]
    keys = F.aggregate("geometry", F.lit(0.0), lambda t, p: t + p[0][0][0])
    return cut.select("feature", F.size("geometry").alias("parts"), keys.alias("keys"))


@query(_MAIN + """, lons AS (SELECT DISTINCT lon FROM (SELECT (x0 + 180) % 360 - 180 AS lon FROM k UNION ALL SELECT (x1 + 180) % 360 - 180 FROM k)),
gaps AS (SELECT lon, lon - lag(lon) OVER (ORDER BY lon) AS gap FROM lons),
arc AS (SELECT min(lon) AS first, max(lon) AS last, max(gap) AS gap, min(lon) FILTER (gap = (SELECT max(gap) FROM gaps)) AS at_lon FROM gaps),
fr AS (SELECT CASE WHEN coalesce(gap, -1) > first + 360 - last THEN at_lon ELSE first END AS start, 360 - greatest(first + 360 - last, coalesce(gap, 0)) AS span,
  (SELECT min(y0) FROM k) AS south, (SELECT max(y1) FROM k) AS north FROM arc)
SELECT (start + span / 2 + 540) % 360 - 180 AS lon0, (south + north) / 2 AS lat0, span, south, north,
  CASE WHEN span > 200 THEN 'equal_earth' WHEN span >= 45 AND abs((south + north) / 2) BETWEEN 20 AND 70 THEN 'albers' ELSE 'laea' END AS projection FROM fr""")
def chosen_frame(spark, sf_dir):
    return frame.framed(spark.createDataFrame([], "feature long, geometry array<array<array<array<double>>>>"), _parts(spark, sf_dir), 3000.0)[1].drop("parallel_1", "parallel_2")


@query("""
WITH b AS (SELECT n_nationkey AS k, (170 - n_nationkey)::DOUBLE AS w, CASE WHEN n_nationkey % 2 = 0 THEN -170.0 ELSE 175 END::DOUBLE AS e, (-10 - n_nationkey)::DOUBLE AS s FROM nation)
SELECT k AS n_nationkey, 129 AS points, w AS west, CASE WHEN e < w THEN e + 360 ELSE e END AS east, round(2 * (CASE WHEN e < w THEN e + 360 ELSE e END - w + 10 - s), 6) AS length FROM b""")
def box_outlines(spark, sf_dir):
    """Boxes by key, some over the seam."""
    k = F.col("n_nationkey")
    o = clip.box_outline((170 - k).cast("double"), (-10 - k).cast("double"), F.when(k % 2 == 0, -170.0).otherwise(175.0), F.lit(10.0))
    xs = F.transform(o, lambda p: p["x"])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(o).alias("points"), F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.round(arcs.line_length(o), 6).alias("length"))


@query("""
WITH q AS (SELECT n_regionkey::BIGINT AS map, (n_nationkey % 5 * 12)::DOUBLE AS x0, (n_nationkey // 5 * 12)::DOUBLE AS y0 FROM nation),
g AS (SELECT m.map, r.r AS row, c.c AS col FROM (SELECT DISTINCT map FROM q) m, range(10) r(r), range(10) c(c))
SELECT map, count(*) FILTER (EXISTS (SELECT 1 FROM q WHERE q.map = g.map AND (col + 0.5) * 6 > x0 AND (col + 0.5) * 6 < x0 + 12 AND (row + 0.5) * 6 > y0 AND (row + 0.5) * 6 < y0 + 12)) AS land FROM g GROUP BY map""")
def land_raster(spark, sf_dir):
    k = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("map"), k.alias("id"), (k % 5 * 12).cast("double").alias("x0"), (F.floor(k / 5) * 12).cast("double").alias("y0"))
    b = b.withColumn("x1", F.col("x0") + 12).withColumn("y1", F.col("y0") + 12)
    e = lambda a, c, d, f: F.struct(F.col(a).alias("x0"), F.col(c).alias("y0"), F.col(d).alias("x1"), F.col(f).alias("y1"))
    edges = F.array(e("x0", "y0", "x1", "y0"), e("x1", "y0", "x1", "y1"), e("x1", "y1", "x0", "y1"), e("x0", "y1", "x0", "y0"))
    return clip.land_grid(b.withColumn("edges", edges), 60, 60).groupBy("map").agg(F.count_if("land").alias("land"))


@query("""
WITH p AS (SELECT s_nationkey AS feature, s_suppkey AS part, 1.0::DOUBLE + s_suppkey % 7 AS area FROM supplier)
SELECT feature, part, area FROM p QUALIFY area >= 4 OR row_number() OVER (PARTITION BY feature ORDER BY area DESC, part) = 1""")
def kept_parts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("feature"), F.col("s_suppkey").alias("part"), (F.col("s_suppkey") % 7 + 1.0).alias("area"))
    return rings.assemble(s, 4.0)


@query("""
WITH p AS (SELECT s_nationkey AS k, s_suppkey AS o, (s_suppkey % 13)::DOUBLE AS v FROM supplier),
a AS (SELECT k, o, CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN v ELSE (lag(v) OVER w + v + lead(v) OVER w) / 3 END AS v FROM p WINDOW w AS (PARTITION BY k ORDER BY o))
SELECT k, o, round(CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN v ELSE (lag(v) OVER w + v + lead(v) OVER w) / 3 END, 6) AS v FROM a WINDOW w AS (PARTITION BY k ORDER BY o)""")
def smoothed_centreline(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("o"), (F.col("s_suppkey") % 13).cast("double").alias("v"))
    return layout.smoothed(p, "k", "o", "v").withColumn("v", F.round("v", 6))


@query("SELECT n_nationkey::BIGINT AS feature, (4 * (1 + n_nationkey % 4))::DOUBLE AS length FROM nation")
def outline_lengths(spark, sf_dir):
    scale = 1 + F.col("feature") % 4
    v = _squares(spark, sf_dir).withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale})
    return layout.path_lengths(v, "feature", "pos").groupBy("feature").agg(F.max("length").alias("length"))


@query("""
WITH v AS (SELECT s_nationkey AS feature, s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN 10.0 ELSE 180.0 END AS x FROM supplier),
c AS (SELECT *, coalesce((x = 180 AND lag(x) OVER w = 180)::INT, 0) AS cut FROM v WINDOW w AS (PARTITION BY feature ORDER BY pos)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY feature ORDER BY pos) AS piece FROM c),
m AS (SELECT *, count(*) OVER (PARTITION BY feature, piece) AS n FROM n)
SELECT feature, count(DISTINCT piece) AS pieces, count(*) AS points FROM m WHERE n >= 2 GROUP BY feature""")
def seamless_lines(spark, sf_dir):
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("feature"), F.lit(0).alias("line"), k.alias("pos"), F.when(k % 3 == 0, 10.0).otherwise(180.0).alias("x"), F.lit(0.0).alias("y"))
    return rings.without_seam(v).groupBy("feature").agg(F.countDistinct("piece").alias("pieces"), F.count(F.lit(1)).alias("points"))


@query("""
WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation),
c(pos, dx, dy) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)),
v AS (SELECT k, pos, i + dx AS x, j + dy AS y FROM n, c)
SELECT k::BIGINT AS feature, pos, round(x + 0.001::DOUBLE * ((SELECT min(k) FROM v o WHERE o.x = v.x AND o.y = v.y) % 2), 9) AS x, y::DOUBLE AS y FROM v""")
def repaired_rings(spark, sf_dir):
    """Squares, every other one a little off to the right: a corner ends where the first of its owners has it."""
    v = _squares(spark, sf_dir)
    off = v.withColumn("x", F.col("x") + F.when(F.col("feature") % 2 == 1, 0.001).otherwise(0.0))
    return snap.repair(off, 0.01)[0].select("feature", "pos", F.round("x", 9).alias("x"), "y")


@query("""
SELECT s_suppkey AS feature, count(*) AS parts, round(sum(area), 9) AS area FROM supplier,
  (VALUES (0, 1.0::DOUBLE), (1, 0.25), (1, 0.25), (3, 15.0), (3, 1.0)) v(kind, area) WHERE s_suppkey % 4 = kind GROUP BY s_suppkey""")
def rebuilt_shapes(spark, sf_dir):
    """Squares stay, bow ties become two triangles, a ring without area goes, of a hole over the edge the outer half is land by the even-odd rule."""
    found = snap.repair(_odd_shapes(spark, sf_dir), 1e-6)[0]
    ring = found.groupBy("feature", "part", "ring").agg(F.abs(rings.ring_area(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("x", "y").alias("p")))), lambda s: s["p"]))).alias("a"))
    part = ring.groupBy("feature", "part").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))
    return part.groupBy("feature").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("area"), 9).alias("area"))
