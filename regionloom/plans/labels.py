"""Queries of the capital, label, language and title operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, naming, spatial
from ..operators import places as P
from ..session import table
from .registry import query


@query("""
WITH s AS (SELECT n_nationkey AS id, (n_nationkey % 5 * 100)::DOUBLE AS x0, (n_nationkey // 5 * 100)::DOUBLE AS y0 FROM nation WHERE n_regionkey < 2),
p AS (SELECT c_custkey AS pid, c_custkey % 3 AS r, (c_custkey * 7 % 520)::DOUBLE + 0.5 AS x, (c_custkey * 11 % 520)::DOUBLE + 0.5 AS y FROM customer),
k AS (SELECT pid, CASE WHEN r = 0 THEN 0 ELSE 1 END AS rank, x, y, EXISTS (SELECT 1 FROM s WHERE x > x0 AND x < x0 + 100 AND y > y0 AND y < y0 + 100) AS within
  FROM p WHERE x BETWEEN 12 AND 498 AND y BETWEEN 12 AND 498)
SELECT pid, rank, within FROM k WHERE within OR rank = 0""")
def shown_capitals(spark, sf_dir):
    n = F.col("n_nationkey")
    x, y = (n % 5 * 100).cast("double"), (F.floor(n / 5) * 100).cast("double")
    e = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    edges = F.array(e(x, y, x + 100, y), e(x + 100, y, x + 100, y + 100), e(x + 100, y + 100, x, y + 100), e(x, y + 100, x, y))
    subject = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(n.alias("id"), x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 100).alias("y1"), edges.alias("edges"))
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("pid"), F.when(k % 3 == 0, 0).otherwise(1).alias("rank"), ((k * 7 % 520) + 0.5).cast("double").alias("x"), ((k * 11 % 520) + 0.5).cast("double").alias("y"))
    return P.shown_capitals(rows, subject, (10.0, 10.0, 500.0, 500.0), "all").select("pid", "rank", "within")


@query("""
WITH l AS (SELECT n_nationkey AS feature, 'en' AS lang, n_name AS text FROM nation WHERE n_nationkey % 4 <> 3
  UNION ALL SELECT n_nationkey, 'fr', CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'La ' || n_name END FROM nation WHERE n_nationkey % 5 <> 1
  UNION ALL SELECT n_nationkey, 'de', 'Das ' || n_name FROM nation),
b AS (SELECT feature, text AS base FROM l WHERE lang = 'en'),
w AS (SELECT b.feature, x.lang FROM b, (VALUES ('fr'), ('de')) x(lang) UNION SELECT feature, lang FROM l WHERE lang <> 'en')
SELECT feature, lang, coalesce(l.text, '') AS text FROM w LEFT JOIN l USING (feature, lang) LEFT JOIN b USING (feature) WHERE l.text IS DISTINCT FROM base""")
def language_variants(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    en = n.where(k % 4 != 3).select(k.alias("feature"), F.lit("en").alias("lang"), name.alias("text"))
    fr = n.where(k % 5 != 1).select(k.alias("feature"), F.lit("fr").alias("lang"), F.when(k % 2 == 0, name).otherwise(F.concat(F.lit("La "), name)).alias("text"))
    de = n.select(k.alias("feature"), F.lit("de").alias("lang"), F.concat(F.lit("Das "), name).alias("text"))
    return P.language_variants(en.unionByName(fr).unionByName(de), "en")


@query("""
WITH v AS (SELECT upper(substr(r_name, 1, 3)) AS code FROM region UNION ALL SELECT 'ISO' UNION ALL SELECT 'BDG')
SELECT code, CASE WHEN code = 'ISO' THEN 'ISO 3166' WHEN code = 'BDG' THEN 'Bangladesh (BDG)' WHEN code = 'ASI' THEN 'Asia (ASI)' ELSE code END AS label FROM v WHERE code <> 'EUR'""")
def worldview_labels(spark, sf_dir):
    views = table(spark, sf_dir, "region").select(F.upper(F.substring("r_name", 1, 3)).alias("code")).unionByName(spark.createDataFrame([("ISO",), ("BDG",)], "code string"))
    countries = spark.createDataFrame([("BGD", "Bangladesh"), ("ASI", "Asia")], "id string, name string")
    return P.worldview_labels(views.withColumn("has_file", F.col("code") != "EUR"), countries)


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN p_name ELSE '' END AS area,
  CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN 'North America' WHEN 3 THEN 'Africa' WHEN 4 THEN 'South Korea' ELSE '' END AS described,
  CASE p_partkey % 5 WHEN 0 THEN 'South Korea' WHEN 1 THEN 'the Soviet Union' ELSE '' END AS broad,
  CASE p_partkey % 5 WHEN 0 THEN p_name || ', Jeju, South Korea' WHEN 1 THEN p_name || ', Soviet Union' WHEN 2 THEN p_name || ', ' || p_type || ', Africa'
    WHEN 3 THEN p_name ELSE '' END AS title FROM part""")
def title_areas(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    category = F.when(k % 4 == 0, F.concat(F.lit("Category:Blank maps of "), name, F.lit(" (old) (new)"))).when(k % 4 == 1, "Category:Maps by country").when(
        k % 4 == 2, F.concat(F.lit("SVG map showing "), name, F.lit(". "))).otherwise("Flags")
    text = F.when(k % 6 == 0, F.concat(F.lit("<b>Blank map</b> of "), "p_type", F.lit("; more"))).when(k % 6 == 1, F.concat(F.lit("map - "), name)).when(
        k % 6 == 2, "A look at North America in 1900").when(k % 6 == 3, "Somewhere in africa.").when(k % 6 == 4, "Roads, south korea: all").otherwise("Southern Koreatown")
    base = F.when(k % 5 == 0, "Provinces of South Korea (old)").when(k % 5 == 1, "1922-1991 the Soviet Union").otherwise("Elsewhere")
    title = F.when(k % 5 == 0, F.concat(F.lit("Locator map of "), name, F.lit(" in Jeju (special marker).svg"))).when(k % 5 == 1, F.concat(name, F.lit("_in_Soviet Union - 1950.png"))).when(
        k % 5 == 2, F.concat(name, F.lit(" in "), "p_type", F.lit(" (Africa).svg"))).when(k % 5 == 3, F.concat(name, F.lit(" on the globe (small).svg"))).otherwise("Blank map in colour.svg")
    found = {"area": naming.area_of_category(category), "described": naming.described_area(text), "broad": naming.broad_area(base), "title": naming.title_area(title, base)}
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return spatial.dealt(parts).select("p_partkey", *(c.alias(n) for n, c in found.items()))


@query("""
WITH p AS (SELECT s_suppkey % 4 AS map, s_suppkey AS pid, length(s_name) * 0.56 * 4 AS w, (s_suppkey // 4 % 3 * 85 + 15)::DOUBLE AS x, (s_suppkey // 12 * 20 + 10)::DOUBLE AS y FROM supplier)
SELECT map, pid, round(CASE WHEN x + 1.8 + w <= 199 THEN x + 1.8 + w / 2 ELSE x - 1.8 - w / 2 END, 6) AS x, y FROM p""")
def point_labels(spark, sf_dir):
    """Points in rows: labels to their right, at the right edge of the map to their left."""
    k = F.col("s_suppkey")
    j = F.floor(k / 4)
    rows = table(spark, sf_dir, "supplier").select((k % 4).alias("map"), k.alias("pid"), F.col("s_name").alias("text"), (j % 3 * 85 + 15).cast("double").alias("x"), (F.floor(k / 12) * 20 + 10).cast("double").alias("y"), (-k).alias("order"))
    return P.point_labels(rows, 4.0, (0.0, 0.0, 200.0, 1e9)).withColumn("x", F.round("x", 6))


def _rectangles(df, map_, id_, text, x, y, w, h):
    corner = lambda a, b: F.array((x + a).cast("double"), (y + b).cast("double"))
    ring = F.array(corner(F.lit(0), F.lit(0)), corner(w, F.lit(0)), corner(w, h), corner(F.lit(0), h), corner(F.lit(0), F.lit(0)))
    return df.select(map_.alias("map"), id_.alias("id"), text.alias("text"), F.array(F.array(ring)).alias("geometry"))


@query("""
WITH r AS (SELECT s_suppkey % 5 AS map, s_suppkey AS id, length(s_name) * 0.56 AS em, s_suppkey // 5 % 4 * 250 AS x0, s_suppkey // 20 * 100 AS y0, 44 + s_suppkey * 7 % 11 * 15 AS w, 44 + s_suppkey % 3 AS h FROM supplier),
s AS (SELECT *, CASE WHEN em * 11 < w THEN 11 WHEN em * 9.35 < w THEN 9.35 WHEN em * 7.7 < w THEN 7.7 END::DOUBLE AS size FROM r)
SELECT map, id, 'straight' AS kind, (x0 + w / 2)::DOUBLE AS x, (y0 + h / 2)::DOUBLE AS y, size FROM s WHERE size IS NOT NULL""")
def region_labels(spark, sf_dir):
    """Rectangles: a name is at its centre, in the first size that fits."""
    k = F.col("s_suppkey")
    r = _rectangles(table(spark, sf_dir, "supplier"), k % 5, k, F.col("s_name"), F.floor(k / 5) % 4 * 250, F.floor(k / 20) * 100, 44 + k * 7 % 11 * 15, 44 + k % 3)
    found = labels.place_labels(r, labels.Options(curved=False))
    return found.select("map", "id", "kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("size", 6).alias("size"))


@query("""
WITH r AS (SELECT s_suppkey % 5 AS map, s_suppkey AS id, length(s_name) * 0.56 * 7.7 AS w, s_suppkey // 5 % 3 * 425 + 22 AS cx, s_suppkey // 15 * 60 + 42 AS cy FROM supplier),
s AS (SELECT *, CASE WHEN cx + 1.5 * 7.7 + w <= 898 THEN 1 ELSE -1 END AS side FROM r)
SELECT map, id, 'leader' AS kind, round(cx + side * (1.5 * 7.7 + w / 2), 6)::DOUBLE AS x, cy::DOUBLE AS y, round(cx + side * 1.5 * 7.7, 6)::DOUBLE AS end_x FROM s""")
def leader_labels(spark, sf_dir):
    """Specks: a name stands to their right, at the edge of the map to their left."""
    k = F.col("s_suppkey")
    r = _rectangles(table(spark, sf_dir, "supplier"), k % 5, k, F.col("s_name"), F.floor(k / 5) % 3 * 425 + 20, F.floor(k / 15) * 60 + 40, F.lit(4), F.lit(4))
    found = labels.place_labels(r, labels.Options(bounds=(0.0, 0.0, 900.0, 1e9)))
    return found.select("map", "id", "kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.col("path")[1][0], 6).alias("end_x"))


@query("""
SELECT s_suppkey % 5 AS map, s_suppkey AS id, 'curved' AS kind, (s_suppkey // 5 * 60 + 9)::DOUBLE AS x, (s_suppkey % 7 * 3 + 200)::DOUBLE AS y,
  CASE WHEN s_suppkey % 2 = 0 THEN 11.0 ELSE 9.35 END::DOUBLE AS size, round(s_suppkey % 7 * 3 + 400 * 23 / 24, 0)::DOUBLE AS first_y, round(s_suppkey % 7 * 3 + 400 / 24, 0)::DOUBLE AS last_y FROM supplier""")
def curved_labels(spark, sf_dir):
    """Slivers of two widths: names run along them, from bottom to top, in the size that their width allows."""
    k = F.col("s_suppkey")
    thin = F.when(k % 2 == 0, 18).otherwise(11)
    r = _rectangles(table(spark, sf_dir, "supplier"), k % 5, k, F.substring("s_name", 1, 8), F.floor(k / 5) * 60 + 9 - thin / 2, k % 7 * 3, thin, F.lit(400))
    found = labels.place_labels(r, labels.Options(leaders=False))
    y = lambda i: F.round(F.element_at("path", i)[1], 0)
    return found.select("map", "id", "kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("size", 6).alias("size"), y(1).alias("first_y"), y(-1).alias("last_y"))


@query("""
WITH n AS (SELECT n_regionkey::BIGINT AS map, n_nationkey * 7 % 14 AS c0, n_nationkey * 11 % 14 AS r0, 3 + n_nationkey % 4 AS s FROM nation),
m AS (SELECT DISTINCT map FROM n),
g AS (SELECT m.map, r.r, c.c FROM m, range(20) r(r), range(20) c(c) WHERE EXISTS (FROM n WHERE n.map = m.map AND c.c >= c0 AND c.c < c0 + s AND r.r >= r0 AND r.r < r0 + s)),
a(position, ax, ay) AS (VALUES ('top-left', 0, 0), ('top-center', 1, 0), ('top-right', 2, 0), ('middle-left', 0, 1), ('center', 1, 1), ('middle-right', 2, 1), ('bottom-left', 0, 2), ('bottom-center', 1, 2), ('bottom-right', 2, 2)),
q AS (SELECT map, position, w.w, h.h, CASE ax WHEN 0 THEN 1 WHEN 1 THEN (20 - w.w) // 2 ELSE 19 - w.w END AS c0, CASE ay WHEN 0 THEN 1 WHEN 1 THEN (20 - h.h) // 2 ELSE 19 - h.h END AS r0 FROM m, a, range(8, 19) w(w), range(8, 19) h(h)),
e AS (SELECT map, position, max({'a': w * h, 'o': -w, 'h': h, 'w': w, 'c': c0, 'r': r0}) AS b FROM q
  WHERE NOT EXISTS (FROM g WHERE g.map = q.map AND g.c >= c0 AND g.c < c0 + w AND g.r >= r0 AND g.r < r0 + h) GROUP BY map, position)
SELECT m.map, a.position, (6 * coalesce(b.c, CASE ax WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 19 END))::DOUBLE AS x, (6 * coalesce(b.r, CASE ay WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 19 END))::DOUBLE AS y,
  (6 * coalesce(b.w, 0))::DOUBLE AS width, (6 * coalesce(b.h, 0))::DOUBLE AS height,
  round((SELECT count(*) FROM g WHERE g.map = m.map AND g.c >= 7 * ax AND g.c < 7 * ax + 6 AND g.r >= 7 * ay AND g.r < 7 * ay + 6) / 36, 3)::DOUBLE AS land_share
FROM m CROSS JOIN a LEFT JOIN e ON e.map = m.map AND e.position = a.position""")
def legend_slots(spark, sf_dir):
    """Nine anchored places on rasters of 20 by 20 cells with squares of land."""
    k = F.col("n_nationkey")
    c0, r0, s = k * 7 % 14, k * 11 % 14, 3 + k % 4
    n = table(spark, sf_dir, "nation")
    land = n.select(F.col("n_regionkey").cast("long").alias("map"), c0.alias("c0"), s.alias("s"), F.explode(F.sequence(r0, r0 + s - 1)).alias("row"))
    land = land.select("map", "row", F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("s") - 1)).alias("col")).distinct().withColumn("land", F.lit(True))
    grid = n.select(F.col("n_regionkey").cast("long").alias("map")).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return labels.legend_slots(grid.join(land, ["map", "row", "col"], "left").withColumn("land", F.coalesce("land", F.lit(False))))
