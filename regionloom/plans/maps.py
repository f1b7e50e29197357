"""Queries of the projection, layout and page operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import layout as L
from ..operators import projection as P
from ..session import table
from ..sources import markup
from .registry import query

_POINTS = """
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 340 - 170)::DOUBLE AS lon, (s_suppkey * 53 % 160 - 80)::DOUBLE AS lat FROM supplier),
c AS (SELECT 6371007.181::DOUBLE AS r),
q AS (SELECT s_suppkey, lon, lat, radians(CASE WHEN lon - 10 < -180 THEN lon + 350 ELSE lon - 10 END) AS lam, radians(lat) AS phi, r FROM p, c)
"""


def _points(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (k * 37 % 340 - 170).cast("double").alias("lon"), (k * 53 % 160 - 80).cast("double").alias("lat"))


def _projected(spark, sf_dir, xy):
    return _points(spark, sf_dir).select("s_suppkey", (F.round(xy[0], 3) + 0.0).alias("x"), (F.round(xy[1], 3) + 0.0).alias("y"))


@query(_POINTS + """
SELECT s_suppkey, round(r * sqrt(2 / (1 + sin(radians(50)) * sin(phi) + cos(radians(50)) * cos(phi) * cos(lam))) * cos(phi) * sin(lam), 3) + 0.0::DOUBLE AS x,
 round(r * sqrt(2 / (1 + sin(radians(50)) * sin(phi) + cos(radians(50)) * cos(phi) * cos(lam))) * (cos(radians(50)) * sin(phi) - sin(radians(50)) * cos(phi) * cos(lam)), 3) + 0.0::DOUBLE AS y FROM q""")
def project_laea(spark, sf_dir):
    return _projected(spark, sf_dir, P.laea(F.col("lon"), F.col("lat"), 10.0, 50.0))


@query(_POINTS + """,
k AS (SELECT (sin(radians(40)) + sin(radians(60))) / 2 AS n), k2 AS (SELECT n, cos(radians(40)) ** 2 + 2 * n * sin(radians(40)) AS cc FROM k)
SELECT s_suppkey, round(r * sqrt(greatest(cc - 2 * n * sin(phi), 0)) / n * sin(n * lam), 3) + 0.0::DOUBLE AS x,
  round(r * sqrt(cc - 2 * n * sin(radians(50))) / n - r * sqrt(greatest(cc - 2 * n * sin(phi), 0)) / n * cos(n * lam), 3) + 0.0::DOUBLE AS y FROM q, k2""")
def project_albers(spark, sf_dir):
    return _projected(spark, sf_dir, P.albers(F.col("lon"), F.col("lat"), 10.0, 50.0, 40.0, 60.0))


@query(_POINTS + """,
k AS (SELECT ln(cos(radians(40)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(30)) / tan(pi() / 4 + radians(20))) AS n),
k2 AS (SELECT n, 6371007.181 * cos(radians(40)) * tan(pi() / 4 + radians(20)) ** n / n AS f FROM k)
SELECT s_suppkey, round(f / tan(pi() / 4 + phi / 2) ** n * sin(n * lam), 3) + 0.0::DOUBLE AS x,
  round(f / tan(pi() / 4 + radians(25)) ** n - f / tan(pi() / 4 + phi / 2) ** n * cos(n * lam), 3) + 0.0::DOUBLE AS y FROM q, k2""")
def project_lambert_conic(spark, sf_dir):
    return _projected(spark, sf_dir, P.lambert_conic(F.col("lon"), F.col("lat"), 10.0, 50.0, 40.0, 60.0))


@query(_POINTS + """,
t AS (SELECT *, asin(sqrt(3) / 2 * sin(phi)) AS th FROM q)
SELECT s_suppkey, round(r * 2 * sqrt(3) * lam * cos(th) / (3 * (9 * 0.003796 * th ** 8 + 7 * 0.000893 * th ** 6 + 3 * -0.081106 * th ** 2 + 1.340264)), 3) + 0.0::DOUBLE AS x,
  round(r * th * (1.340264 + -0.081106 * th ** 2 + th ** 6 * (0.000893 + 0.003796 * th ** 2)), 3) + 0.0::DOUBLE AS y FROM t""")
def project_equal_earth(spark, sf_dir):
    return _projected(spark, sf_dir, P.equal_earth(F.col("lon"), F.col("lat"), 10.0))


@query("SELECT s_suppkey, ((s_suppkey * 37 - 500 + 180) % 360 + 360) % 360 - 180.0::DOUBLE AS lon FROM supplier")
def wrapped_longitudes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.wrap_longitude((F.col("s_suppkey") * 37 - 500).cast("double")).alias("lon"))


@query("""
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 340 - 170)::DOUBLE AS lon, (s_suppkey * 53 % 160 - 80)::DOUBLE AS lat FROM supplier)
SELECT s_suppkey FROM p WHERE ((lon - 135)::INT % 360 + 360) % 360 <= 90 AND lat BETWEEN -15 AND 35""")
def visible_context(spark, sf_dir):
    """Points near an extent of 40 degrees from 160 E over the antimeridian."""
    return _points(spark, sf_dir).where(P.near_extent(F.col("lon"), F.col("lat"), 160.0, 40.0, -10.0, 30.0)).select("s_suppkey")


_GRID = "WITH g AS (SELECT p_type, p_size // 10 AS row, substr(p_brand, 7)::INT AS col, count(*) AS n FROM part GROUP BY ALL)"


def _grid(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_type", F.floor(F.col("p_size") / 10).cast("int").alias("row"), F.substring("p_brand", 7, 9).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))


def _whole_grid(spark, sf_dir):
    """Every cell of the grid, empty ones with 0: prefix sums need whole rows and columns."""
    g = _grid(spark, sf_dir)
    cells = g.select("p_type").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(25))))
    return cells.join(g, ["p_type", "row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(_GRID + """
SELECT t.p_type, r.row::INT AS row, c.col::INT AS col, (SELECT coalesce(sum(n), 0) FROM g WHERE g.p_type = t.p_type AND g.row <= r.row AND g.col <= c.col)::BIGINT AS total
FROM (SELECT DISTINCT p_type FROM g) t, range(6) r(row), range(26) c(col)""")
def summed_area(spark, sf_dir):
    return L.summed_area(_whole_grid(spark, sf_dir), ["p_type"], "n").select("p_type", "row", "col", "total")


@query(_GRID + "SELECT p_type, count(*) FILTER (row BETWEEN 1 AND 3 AND col BETWEEN 5 AND 12 AND n > 1) AS n FROM g GROUP BY p_type")
def land_count(spark, sf_dir):
    return L.land_count(_grid(spark, sf_dir).withColumn("land", F.col("n") > 1), ["p_type"], 1, 3, 5, 12)


@query("""
WITH c AS (SELECT n_regionkey::BIGINT AS map, n_nationkey::BIGINT AS pos, (n_nationkey * 10)::DOUBLE AS x0, (n_nationkey * 7 % 5)::BIGINT AS land FROM nation),
t AS (SELECT r_regionkey::BIGINT AS map, (r_regionkey * 50)::DOUBLE AS x0 FROM region),
free AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.map = c.map AND c.x0 < t.x0 + 8 + 4 AND t.x0 < c.x0 + 8 + 4))
SELECT map, arg_min(pos, land * 1000 + pos) AS pos, min(land) AS land FROM free GROUP BY map""")
def inset_places(spark, sf_dir):
    k = F.col("n_nationkey")
    x = (k * 10).cast("double")
    c = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("map"), k.cast("long").alias("pos"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 8).alias("x1"), F.lit(8.0).alias("y1"), (k * 7 % 5).cast("long").alias("land"))
    tx = (F.col("r_regionkey") * 50).cast("double")
    t = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("map"), tx.alias("x0"), F.lit(0.0).alias("y0"), (tx + 8).alias("x1"), F.lit(8.0).alias("y1"))
    return L.place_box(c, t).select("map", "pos", "land")


@query("""
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)).len()::INT AS links FROM pages""")
def page_attributes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return p.select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.size(links).alias("links"))


@query("SELECT 'N' || n_nationkey || '&' AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'U' || n_regionkey END AS unit FROM nation")
def svg_codes(spark, sf_dir):
    """A document with one land path and one context path a nation, read back."""
    k = F.col("n_nationkey").cast("string")
    unit = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(' data-unit="U'), F.col("n_regionkey").cast("string"), F.lit('"'))).otherwise("")
    land = F.concat(F.lit('<path class="mg-land region" data-code="N'), k, F.lit('&amp;"'), unit, F.lit(' d="M0 0Z"/>'))
    other = F.concat(F.lit('<path class="mg-context" data-code="X'), k, F.lit('" d="M0 0Z"/>'))
    return markup.svg_codes(table(spark, sf_dir, "nation").select(F.concat(land, other).alias("svg")), "svg")


@query("""SELECT n_nationkey::BIGINT AS id, (n_nationkey + 1)::DOUBLE AS distance, (n_nationkey % 6 + n_nationkey + 1)::DOUBLE AS x, (n_nationkey + 1)::DOUBLE AS y FROM nation""")
def label_poles(spark, sf_dir):
    """Right triangles of sides 3, 4 and 5 by key: the pole is the centre of the circle inside."""
    k = F.col("n_nationkey")
    ring = F.array(*[F.array((k % 6 + F.lit(x) * (k + 1)).cast("double"), (F.lit(y) * (k + 1)).cast("double")) for x, y in ((0, 0), (4, 0), (0, 3))])
    p = L.poles(table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), ring.alias("ring")), 1e-4)
    return p.select("id", F.round("distance", 2).alias("distance"), F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))
