"""Queries of the readers and writers: texts and files are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import rings
from ..sources import documents, geojson, gpkg, tables, wikitext
from ..session import table
from .registry import query
from .shapes import _squares


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _square(k):
    x = (k * 10).cast("double")
    c = lambda dx, dy: F.array(x + dx, F.lit(float(dy)))
    return F.array(F.array(c(0, 0), c(5, 0), c(5, 5), c(0, 5), c(0, 0)))


def _collections(spark, sf_dir):
    k = F.col("n_nationkey")
    code = F.when(k % 3 == 0, "NA").otherwise(F.concat(F.lit("C"), k.cast("string")))
    props = F.create_map(F.lit("code"), code, F.lit("UID"), F.concat(F.lit("U"), k.cast("string")), F.lit("name"), F.col("n_name"), F.lit("Group"), F.concat(F.lit(" "), "r_name"))
    geometry = F.when(k % 7 != 6, F.struct(F.lit("Polygon").alias("type"), _square(k).alias("coordinates")))
    return geojson.to_text(_nations(spark, sf_dir), "n_regionkey", F.concat(F.lit("f"), k.cast("string")), props, geometry)


_FEATURES = """
WITH f AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'U' || n_nationkey ELSE 'C' || n_nationkey END AS id, n_name AS name, r_name AS region, (n_nationkey * 10)::DOUBLE AS x0
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 6)
"""


@query(_FEATURES + "SELECT id, name, region, x0 FROM f")
def geojson_features(spark, sf_dir):
    """Collections written as text and read back: 'NA' codes fall back to the second id column."""
    f = geojson.features(geojson.records(_collections(spark, sf_dir)), ["code", "uid"], "name", "group")
    return f.select("id", "name", "region", F.col("geometry")[0][0][0][0].alias("x0"))


@query(_FEATURES + "SELECT id, name FROM f WHERE region = 'ASIA'")
def geojson_region(spark, sf_dir):
    return geojson.features(geojson.records(_collections(spark, sf_dir)), ["code", "uid"], "name", "group", "ASIA").select("id", "name")


@query(_FEATURES + "SELECT DISTINCT region FROM f")
def geojson_regions(spark, sf_dir):
    return geojson.regions(geojson.features(geojson.records(_collections(spark, sf_dir)), ["code"], "name", "group"))


_GPKG = "WITH f AS (SELECT n_nationkey, n_name, r_name, n_regionkey, (n_nationkey * 10)::DOUBLE AS x0 FROM nation JOIN region ON n_regionkey = r_regionkey) "


def _packages(spark, sf_dir):
    k = F.col("n_nationkey")
    props = F.create_map(F.lit("code"), F.concat(F.lit("C"), k.cast("string")), F.lit("odd key!"), F.col("n_name"), F.lit("grp"), F.when(k % 2 == 0, "even").otherwise("odd"))
    rows = _nations(spark, sf_dir).select(F.col("r_name").alias("file"), k.alias("id"), props.alias("properties"), F.array(_square(k)).alias("geometry"))
    return gpkg.write(rows, "file", "areas", ["code", "code"])


@query(_GPKG + "SELECT r_name AS file, 'C' || n_nationkey AS code, n_name AS name, x0 FROM f")
def geopackage_features(spark, sf_dir):
    """One file a region, written as bytes and read back; names are made plain."""
    g = gpkg.read(_packages(spark, sf_dir), "areas")
    return g.select("file", F.col("properties")["code"].alias("code"), F.col("properties")["odd_key_"].alias("name"), F.col("geometry")[0][0][0][0].alias("x0"))


@query(_GPKG + "SELECT r_name AS file, 'C' || n_nationkey AS code FROM f WHERE n_nationkey % 2 = 0 AND x0 + 5 >= 40 AND x0 <= 120")
def geopackage_filtered(spark, sf_dir):
    """Region and box are part of the file's own SELECT."""
    g = gpkg.read(_packages(spark, sf_dir), None, "grp", "even", (40.0, -1.0, 120.0, 9.0))
    return g.select("file", F.col("properties")["code"].alias("code"))


@query("""SELECT n_regionkey, 'C' || n_nationkey AS code, n_name AS name FROM nation""")
def delimited_tables(spark, sf_dir):
    """Pipe-separated texts, sniffed and parsed."""
    line = F.concat_ws(" | ", F.concat(F.lit("C"), F.col("n_nationkey").cast("string")), "n_name")
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("﻿code|name\r\n"), F.array_join(F.collect_list(line), "\r\n"), F.lit("\r\n\r\n")).alias("text"))
    return tables.parse_text(texts, "text", ["code", "name"]).select("n_regionkey", "code", "name")


@query("""SELECT s_suppkey, s_name || ', CC ' || CASE WHEN s_suppkey % 2 = 0 THEN 'BY-SA' ELSE 'BY' END AS credit, s_suppkey % 2 = 0 AS share_alike FROM supplier""")
def license_credits(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("source"), F.when(F.col("s_suppkey") % 2 == 0, "CC BY-SA").otherwise("CC BY").alias("license"))
    return tables.license_credit(rows).select("s_suppkey", "credit", "share_alike")


@query("SELECT c_name || ',' || c_mktsegment || ',\"a, b\"' AS line FROM customer")
def csv_sink(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    out = tables.csv_lines(c, {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "note": F.lit("a, b")})
    return out.toDF("line")


@query("""SELECT n_nationkey::BIGINT AS feature, 'M' || x || ',' || y || 'L' || (x + 1) || ',' || y || 'L' || (x + 1) || ',' || (y + 1) || 'L' || x || ',' || (y + 1) || 'Z' AS d
FROM (SELECT n_nationkey, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation)""")
def path_texts(spark, sf_dir):
    return documents.ring_path(_squares(spark, sf_dir))


@query("SELECT r_name AS map, count(*)::INT AS paths FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def svg_documents(spark, sf_dir):
    """One document a region; its land paths are counted by reading it back."""
    paths = documents.ring_path(_squares(spark, sf_dir))
    n = _nations(spark, sf_dir).join(paths, F.col("n_nationkey") == F.col("feature"))
    e = n.select(F.col("r_name").alias("map"), F.lit(1).alias("layer"), F.col("n_nationkey").alias("pos"), documents.path_element("mg-land", F.col("n_name"), F.col("n_name"), F.col("d")).alias("t"))
    docs = documents.svg(e, "map", "layer", "pos", "t", 100, 100)
    page = documents.html(F.col("svg"), F.col("map"))
    return docs.select("map", F.size(F.regexp_extract_all(page, F.lit('class="mg-land"'), F.lit(0))).alias("paths"))


@query("""
SELECT n_nationkey::BIGINT AS feature, 5::BIGINT AS n, (5 * (n_nationkey % 5) + 2)::DOUBLE AS xs FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 7 <> 6""")
def cleaned_rings(spark, sf_dir):
    """Vertices repeated by key, rings closed or left open; of some only two points are left, others have a vertex that is no number."""
    v = _squares(spark, sf_dir)
    k = F.col("feature")
    v = v.where((k % 5 != 4) | (F.col("pos") < 2)).where((k % 2 == 0) | (F.col("pos") < 4))
    v = v.withColumn("x", F.when((k % 7 == 6) & (F.col("pos") == 1), float("nan")).otherwise(F.col("x")))
    many = v.withColumn("again", F.explode(F.sequence(F.lit(0), (k % 3).cast("int")))).withColumn("pos", F.col("pos") * 4 + F.col("again")).drop("again")
    return rings.clean_rings(many).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("xs"))


@query("""
SELECT n_nationkey::BIGINT AS feature, sum((n_nationkey + p.p) % 4)::BIGINT AS n FROM nation, range(3) p(p) GROUP BY 1 HAVING sum((n_nationkey + p.p) % 4) > 0""")
def repeated_vertices(spark, sf_dir):
    v = _squares(spark, sf_dir).where("pos < 3")
    times = ((F.col("feature") + F.col("pos")) % 4).cast("int")
    many = v.withColumn("again", F.explode(F.sequence(F.lit(0), times))).withColumn("pos", F.col("pos") * 4 + F.col("again")).drop("again")
    return rings.repeated_vertices(many)


@query("""
WITH s AS (SELECT s_suppkey, 20 + s_suppkey % 100 AS step, ((s_suppkey * 37 + 180) % 360 + 360) % 360 - 180.0::DOUBLE AS base FROM supplier),
f AS (SELECT *, base - 360 * round((base - 180) / 360) AS first FROM s)
SELECT s_suppkey, list_transform(range(6), lambda i: first + i * step) AS lons FROM f""")
def unwrapped_longitudes(spark, sf_dir):
    """Walks eastward in equal steps by key, wrapped at every step, made continuous again."""
    k = F.col("s_suppkey")
    walk = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: S.wrap_longitude((k * 37 + i * (20 + k % 100)).cast("double")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", rings.unwrap(walk, 180.0).alias("lons"))


@query("""
SELECT p_partkey, lower(p_name) || ' ' || p_size AS k, CASE WHEN p_size % 2 = 0 THEN 'c_' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '9' ELSE '' END || replace(replace(p_name, ' ', '_'), '-', '_') AS col,
 round(length(p_name) * 0.56::DOUBLE * 10, 6) AS width, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title FROM part""")
def name_scalars(spark, sf_dir):
    c = F.col("p_name")
    column = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("9"), c)).otherwise(c)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lower(c), "p_size").alias("k"), S.sql_name(column).alias("col"),
        F.round(S.text_width(c, 10.0), 6).alias("width"), S.page_title(F.replace(c, F.lit(" "), F.lit("_"))).alias("title"))


@query("""
WITH r AS (SELECT r_regionkey AS id, count(*)::INT AS n, array_agg(n_name ORDER BY n_nationkey) AS names, min(n_nationkey) AS low FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT id, CASE WHEN id % 2 = 0 THEN 'countries' ELSE 'mixed' END AS dataset, n AS regions, names[1] AS first, low::VARCHAR || '%' AS value,
  CASE WHEN id % 3 = 0 THEN 'africa' WHEN id % 3 = 1 THEN NULL ELSE (id - 22.5)::DECIMAL(6,2) || ';' || '-17.58;' || (id + 22.5)::DECIMAL(6,2) || ';17.58' END AS bbox,
  CASE WHEN id % 3 = 1 THEN 2 ELSE 1 END AS notes FROM r""")
def choropleth_recipes(spark, sf_dir):
    """A template a region, its nations on lines with a value, links and footnotes between."""
    n = _nations(spark, sf_dir)
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit("%: [[X ("), "n_nationkey", F.lit(")|"), "n_name", F.lit("]]<ref>a, b</ref>; "))
    lists = n.groupBy(F.col("r_regionkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda s: s["l"]), "\n").alias("list"))
    key = F.when(F.col("id") % 2 == 0, "countries").otherwise("states")
    view = F.when(F.col("id") % 3 == 0, "|view=Africa").when(F.col("id") % 3 == 1, "|view=Nowhere").otherwise(F.concat(F.lit("|latitude=0|zoom=3|longitude="), "id", F.lit("|width=256|height=200")))
    text = F.concat(F.lit("Text {{Other|x}} {{Choropleth map\n| "), key, F.lit(" = \n"), "list", F.lit("\n"), view, F.lit("}} more"))
    r = wikitext.choropleth_recipes(lists.select("id", text.alias("text")), "id", "text")
    return r.select("id", "dataset", F.size("regions").alias("regions"), F.col("regions")[0].alias("first"), F.col("values")[F.col("regions")[0]].alias("value"), F.col("params")["bbox"].alias("bbox"), F.size("notes").alias("notes"))
