"""Queries of the composite jobs: selections, ids taken over, a layer's check, batches, pickers, bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dissolve, jobs, listing, naming
from ..session import table
from ..sources import layers
from .registry import query


@query("""
WITH r AS (SELECT n_regionkey || '-' || n_nationkey AS code, 1 AS level, 'land ' || n_nationkey % 7 AS name, n_name AS alias FROM nation
  UNION ALL SELECT r_regionkey::VARCHAR, 0, lower(r_name), 'land ' || r_regionkey FROM region UNION ALL SELECT 'world', 0, 'All', NULL),
i AS (SELECT s_suppkey % 9 AS sel, s_suppkey AS pos, CASE s_suppkey % 5 WHEN 0 THEN 'Land ' || s_suppkey % 8 || ' (state)' WHEN 1 THEN s_nationkey % 5 || '-' || s_nationkey
  WHEN 2 THEN 'nation_' || s_nationkey WHEN 3 THEN 'LAND ' || s_suppkey % 7 ELSE CASE WHEN s_suppkey % 45 = 4 THEN 'WORLD' ELSE 'nation_' || s_suppkey % 25 END END AS input FROM supplier),
h AS (SELECT DISTINCT sel, pos, code, level FROM i JOIN r ON lower(regexp_replace(input, ' \\(state\\)$', '')) IN (lower(name), lower(alias)) OR lower(input) = code),
c AS (SELECT *, CASE WHEN level > 0 THEN split_part(code, '-', 1) END AS country, count(*) OVER (PARTITION BY sel, pos) AS n FROM h),
s AS (SELECT sel, country, count(*) AS shared FROM c WHERE n = 1 AND country IS NOT NULL GROUP BY ALL),
o AS (SELECT c.*, row_number() OVER (PARTITION BY c.sel, pos ORDER BY level, coalesce(shared, 0) DESC, code) AS rank FROM c LEFT JOIN s ON s.sel = c.sel AND s.country = c.country)
SELECT i.sel, i.pos, i.input, o.code FROM i LEFT JOIN o ON o.sel = i.sel AND o.pos = i.pos AND rank = 1""")
def selection_levels(spark, sf_dir):
    """Names shared by several regions: the lowest level, then the country that other inputs are in, then the code."""
    return jobs.pick_regions(*_selection(spark, sf_dir)).select("sel", "pos", "input", "code")


def _selection(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    text = lambda c: F.col(c).cast("string")
    land = lambda c: F.concat(F.lit("land "), c.cast("string"))
    regions = n.select(F.concat_ws("-", text("n_regionkey"), text("n_nationkey")).alias("code"), F.lit(1).alias("level"), land(F.col("n_nationkey") % 7).alias("name"), F.array("n_name").alias("aliases"))
    regions = regions.unionByName(r.select(text("r_regionkey").alias("code"), F.lit(0).alias("level"), F.lower("r_name").alias("name"), F.array(land(F.col("r_regionkey"))).alias("aliases")))
    regions = regions.unionByName(spark.createDataFrame([("world", 0, "All", None)], "code string, level int, name string, aliases array<string>"))
    k, nk = F.col("s_suppkey"), F.col("s_nationkey")
    nation = lambda c: F.concat(F.lit("nation_"), c.cast("string"))
    said = F.when(k % 5 == 0, F.concat(F.lit("Land "), (k % 8).cast("string"), F.lit(" (state)"))).when(k % 5 == 1, F.concat_ws("-", (nk % 5).cast("string"), nk.cast("string")))
    said = said.when(k % 5 == 2, nation(nk)).when(k % 5 == 3, F.concat(F.lit("LAND "), (k % 7).cast("string"))).when(k % 45 == 4, "WORLD").otherwise(nation(k % 25))
    return s.select((k % 9).alias("sel"), k.alias("pos"), said.alias("input")), regions


def _slot(k):
    """Lower left corner of slot k of a grid of 24 slots a row, 4 apart."""
    return (k % 24 * 4).cast("double"), (F.floor(k / 24) * 4).cast("double")


def _box(x, y, w, h):
    c = lambda a, b: F.array(x + a, y + b)
    return F.array(F.array(F.array(c(F.lit(0.0), F.lit(0.0)), c(w, F.lit(0.0)), c(w, h), c(F.lit(0.0), h), c(F.lit(0.0), F.lit(0.0)))))


_TAKEN = """
WITH r AS (SELECT p_partkey AS pos, p_partkey AS k FROM part UNION ALL SELECT 10000000 + p_partkey, p_partkey FROM part WHERE p_partkey % 7 = 1),
m AS (SELECT pos, CASE WHEN k % 3 <> 0 THEN 'R' || k END AS code, CASE WHEN k % 3 <> 0 THEN p_brand END AS parent, k % 3 <> 0 AND pos >= 10000000 AS reused FROM r JOIN part ON p_partkey = k)
"""


def _taken(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    x, y = _slot(k)
    one = F.lit(1.0)
    records = p.select(k.alias("pos"), _box(x, y, one, one).alias("geometry"))
    records = records.unionByName(p.where(k % 7 == 1).select((k + 10_000_000).alias("pos"), _box(x, y, one, one).alias("geometry")))
    code = F.concat(F.lit("R"), k.cast("string"))
    whole = p.where(k % 3 == 1).select((k * 2).alias("pos"), code.alias("c"), "p_brand", _box(x + 0.1, y, one, one).alias("geometry"))
    halves = p.where(k % 3 == 2).select((k * 2).alias("pos"), code.alias("c"), "p_brand", _box(x, y + 0.05, F.lit(0.5), one).alias("geometry"))
    halves = halves.unionByName(p.where(k % 3 == 2).select((k * 2 + 1).alias("pos"), code.alias("c"), F.lit("later").alias("p_brand"), _box(x + 0.5, y + 0.05, F.lit(0.5), one).alias("geometry")))
    refs = dissolve.grouped_references(whole.unionByName(halves), F.col("c"), F.col("p_brand"))
    return jobs.take_ids(records, refs, 0.5, 4.0)


@query(_TAKEN + "SELECT * FROM m")
def taken_ids(spark, sf_dir):
    """Codes of the references that are the same place; references of two features are their union."""
    return _taken(spark, sf_dir).select("pos", "code", "parent", "reused")


@query(_TAKEN + """, u AS (SELECT pos FROM m WHERE code IS NULL)
SELECT (SELECT count(code) FROM m) AS matched, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m WHERE reused) AS reused,
  (SELECT string_agg('#' || pos, ', ' ORDER BY pos) FROM (FROM u ORDER BY pos LIMIT 8)) || CASE WHEN (SELECT count(*) FROM u) > 8 THEN ' and ' || ((SELECT count(*) FROM u) - 8) || ' more' ELSE '' END AS unmatched""")
def taken_report(spark, sf_dir):
    return jobs.take_report(_taken(spark, sf_dir), F.lit(None).cast("string"))


@query("""
WITH f AS (SELECT s_suppkey AS k, s_suppkey % 8 AS v FROM supplier)
SELECT k AS feature, 'duplicate_id' AS kind, NULL AS other FROM f WHERE k % 10 = 0 AND (SELECT count(*) FROM f WHERE k % 10 = 0) > 1
UNION ALL SELECT k, 'empty', NULL FROM f WHERE v = 2
UNION ALL SELECT k, 'out_of_range', NULL FROM f WHERE k % 48 = 6
UNION ALL SELECT k, 'duplicate_points', NULL FROM f WHERE v = 5
UNION ALL SELECT k, 'sliver', NULL FROM f WHERE v IN (3, 4)
UNION ALL SELECT k, 'invalid', NULL FROM f WHERE v = 4
UNION ALL SELECT k - 1, 'overlap', k::VARCHAR FROM f WHERE v = 1 AND k - 1 IN (SELECT k FROM f)
UNION ALL SELECT k - 1, 'near_miss_border', k::VARCHAR FROM f WHERE v = 7 AND k % 48 <> 7 AND k - 1 IN (SELECT k FROM f)""")
def layer_issues(spark, sf_dir):
    """Squares on a grid with room for 10^8 of them on the globe, and among them by key: overlaps, empty ones, slivers, bow ties,
    repeated vertices, near misses.
    """
    k = F.col("s_suppkey")
    v, side = k % 8, 1 / 128
    one = F.lit(side)
    place = lambda k: ((k % 16384 / 64 - 128).cast("double"), (F.floor(k / 16384) / 64 - 80).cast("double"))
    px, py = place(k - 1)
    x, y = place(k)
    y = F.when(k % 48 == 6, 95.0 + F.floor(k / 24)).otherwise(y)
    c = lambda a, b: F.array(x + a * side, y + b * side)
    bow = F.array(F.array(F.array(c(0, 0), c(1, 1), c(1, 0), c(0, 1), c(0, 0))))
    twice = F.array(F.array(F.array(c(0, 0), c(1, 0), c(1, 0), c(1, 1), c(0, 1), c(0, 0))))
    none = F.array().cast("array<array<array<array<double>>>>")
    shape = F.when(v == 1, _box(px + side / 2, py, one, one)).when(v == 2, none).when(v == 3, _box(x, y, one, F.lit(1e-5))).when(v == 4, bow).when(v == 5, twice)
    shape = shape.when(v == 7, _box(px + side + 0.00005, py, one, one)).otherwise(_box(x, y, one, one))
    name = F.when(k % 10 == 0, "same").otherwise(F.concat(F.lit("S"), k.cast("string")))
    return jobs.check_layer(table(spark, sf_dir, "supplier").select(k.alias("feature"), name.alias("id"), shape.alias("geometry")), size=side).select("feature", "kind", "other")


_BATCH = """
WITH j AS (SELECT c_mktsegment AS file, c_nationkey::VARCHAR AS region, count(*) AS features, sum(c_custkey) AS keys,
  CASE WHEN c_nationkey % 6 = 5 THEN 'map-' || c_nationkey ELSE regexp_replace(c_mktsegment || ' ' || c_nationkey, '[^A-Za-z0-9._-]', '_', 'g') END AS name FROM customer GROUP BY ALL),
o AS (SELECT *, count(*) OVER (PARTITION BY name) AS jobs FROM j),
b AS (SELECT file, region, name, features, CASE WHEN jobs = 1 AND features >= 3 THEN features || ' shapes, ' || keys END AS output,
  CASE WHEN jobs > 1 THEN name || ' is the name of several jobs' WHEN features < 3 THEN 'ValueError: nothing to draw' END AS error FROM o)
"""


def _batch(spark, sf_dir):
    def render(rows):
        if len(rows) < 3:
            raise ValueError("nothing to draw")
        return f"{len(rows)} shapes, {int(rows['c_custkey'].sum())}"

    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("file"), F.col("c_nationkey").cast("string").alias("region"), "c_custkey")
    k = F.col("region").cast("int")
    name = F.when(k % 6 == 5, F.concat(F.lit("map-"), "region")).otherwise(naming.file_name("file", "region"))
    return jobs.run_batch(c, render, name)


@query(_BATCH + "SELECT * FROM b")
def batch_jobs(spark, sf_dir):
    """A job a file and region: rendered, failed, or not run because its name is another's too."""
    return _batch(spark, sf_dir)


@query(_BATCH + "SELECT count(output) AS done, count(*) - count(output) AS failed, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (output IS NOT NULL AND region::INT % 3 = 0), '') AS share_alike FROM b")
def batch_report(spark, sf_dir):
    return jobs.batch_report(_batch(spark, sf_dir), F.col("region").cast("int") % 3 == 0)


@query("""
WITH s AS (SELECT s_nationkey AS id FROM supplier WHERE s_acctbal < 0), c AS (SELECT c_nationkey AS id FROM customer WHERE c_acctbal < 0), r AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey IN (1, 3)),
o AS (SELECT DISTINCT id FROM s WHERE id IN (FROM r))
SELECT id FROM o UNION ALL SELECT DISTINCT id FROM c WHERE id IN (FROM r) AND NOT EXISTS (FROM o)""")
def picker_codes(spark, sf_dir):
    s, c, n = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    regions = n.where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("id"))
    return jobs.picker(s.where("s_acctbal < 0").select(F.col("s_nationkey").alias("id")), c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("id")), regions)


@query("""
WITH o AS (SELECT c_custkey AS town, c_nationkey AS county, round(c_acctbal * 100)::BIGINT AS land FROM customer WHERE c_acctbal > 0),
n AS (SELECT c_custkey AS town, c_mktsegment AS region FROM customer WHERE c_custkey % 10 <> 0)
SELECT county, region, sum(land)::BIGINT AS land FROM o JOIN n USING (town) GROUP BY ALL""")
def bridge_join(spark, sf_dir):
    """Land that moved from old to new areas, by the towns that both versions know."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("town"), F.col("c_nationkey").alias("county"), F.round(F.col("c_acctbal") * 100).cast("long").alias("land"))
    new = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("town"), F.col("c_mktsegment").alias("region"))
    return jobs.bridge(old, new, ("county", "region"), "town", "land")


@query("""
WITH d AS (SELECT p_partkey AS k, p_name AS area, p_partkey % 7 AS v FROM part)
SELECT k, CASE v WHEN 0 THEN 'Locator map for ' || area || '; shows the named area within a wider region.' WHEN 1 THEN 'Own words on ' || area || '.'
  WHEN 2 THEN 'Physical or topographic blank map of ' || area || '; see the source categories for detail.' WHEN 3 THEN 'Historical blank map of ' || area || '; see the title and source categories for its period and scope.'
  WHEN 4 THEN 'Blank-map file titled “' || 'X ' || k || '”; its coverage is unclear from Commons metadata.' WHEN 5 THEN 'Head of ' || area ELSE 'Outline map of ' || area || ', intended for adding labels or data; see categories for its scope.' END AS text FROM d""")
def short_descriptions(spark, sf_dir):
    k, area = F.col("p_partkey"), F.col("p_name")
    v = k % 7
    title = F.when(v == 0, F.concat(area, F.lit(" location map.svg"))).when(v == 2, "Terrain-of-it.svg").when(v == 3, "It_in_1789.svg").when(v == 4, F.concat(F.lit("X_"), k.cast("string"), F.lit(".svg"))).otherwise("It.svg")
    own = F.when(v == 1, F.concat(F.lit("Own <i>words</i> on "), area, F.lit("."))).when(v == 5, F.concat(F.lit("Head of "), area, F.lit(", based on "), F.repeat(F.lit("much "), 100)))
    about = naming.short_description(title, F.when(v == 4, naming.UNCLEAR).otherwise(area), own, F.lit(False))
    return table(spark, sf_dir, "part").select(k.alias("k"), about.alias("text"))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey FROM supplier), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3)
SELECT k, CASE WHEN k % 4 = 0 THEN 'f' || k ELSE s_nationkey::VARCHAR END AS code, coalesce(CASE WHEN k % 4 <> 0 THEN n_name END, CASE WHEN k % 4 = 0 THEN 'f' || k ELSE s_nationkey::VARCHAR END) AS name,
  CASE WHEN k % 3 = 0 THEN 'ADM2' ELSE 'ADM1' END AS level, CASE WHEN k % 5 = 0 THEN '' ELSE (2000 + k % 20)::VARCHAR END AS year FROM s LEFT JOIN n ON n_nationkey = s_nationkey""")
def template_variables(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        k.alias("k"), F.concat(F.lit("f"), k.cast("string")).alias("stem"), F.when(k % 4 != 0, F.col("s_nationkey").cast("string")).alias("code"),
        F.when(k % 3 == 0, "ADM2").alias("sidecar_level"), F.when(k % 5 != 0, (2000 + k % 20).cast("string")).alias("sidecar_year"), F.lit(None).cast("string").alias("credit"),
    )
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    v = naming.template_variables(s, n, "ADM1")
    return v.select("k", *[F.col("vars")[c].alias(c) for c in ("code", "name", "level", "year")])


@query("""
WITH r AS (SELECT c_nationkey % 9 AS d, c_custkey AS code, c_mktsegment AS credit, 'r' || c_custkey % 4 AS release FROM customer WHERE c_nationkey % 9 <> 8),
g AS (SELECT d, count(*) AS n, arg_min(credit, code) AS credit, arg_min(release, code) AS release FROM r GROUP BY d)
SELECT 'd' || s.d AS dataset, s.d % 2 = 0 AS per_region, coalesce(n, 0) AS regions, CASE WHEN s.d % 2 = 1 THEN credit END AS credit, CASE WHEN s.d % 2 = 1 THEN release END AS release
FROM (SELECT DISTINCT n_nationkey % 9 AS d FROM nation) s LEFT JOIN g USING (d)""")
def dataset_listing(spark, sf_dir):
    """Data sets with the number of their regions; those of one file tell its origin."""
    d = F.col("n_nationkey") % 9
    catalogue = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), d.cast("string")).alias("dataset"), (d % 2 == 0).alias("per_region")).distinct()
    k = F.col("c_custkey")
    regions = table(spark, sf_dir, "customer").where("c_nationkey % 9 <> 8").select(F.concat(F.lit("d"), (F.col("c_nationkey") % 9).cast("string")).alias("dataset"), k.alias("code"), F.col("c_mktsegment").alias("credit"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("release"))
    return listing.datasets(catalogue, regions)


@query("""
SELECT CASE WHEN n_nationkey = 3 THEN 'world' ELSE 'N' || n_nationkey END AS code, CASE WHEN n_regionkey = 0 THEN 'CONTINENT' WHEN n_regionkey = 1 THEN 'ISO' END AS "column",
  CASE WHEN n_regionkey = 0 THEN 'continent' WHEN n_regionkey = 1 THEN 'region' WHEN n_nationkey = 3 THEN 'world' ELSE 'file' END AS kind FROM nation""")
def region_listing(spark, sf_dir):
    code = F.when(F.col("n_nationkey") == 3, "world").otherwise(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    column = F.when(F.col("n_regionkey") == 0, "CONTINENT").when(F.col("n_regionkey") == 1, "ISO")
    return listing.region_kinds(table(spark, sf_dir, "nation").select(code.alias("code"), column.alias("column")))


@query("""
SELECT p_partkey AS code, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'Das ' || p_name END AS de, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN p_size % 3 = 0 AND p_size % 2 <> 0 THEN 1 ELSE 0 END AS names, p_type AS parent FROM part WHERE p_brand < 'Brand#3'""")
def feature_listing(spark, sf_dir):
    """A region's features with their names in two of three languages; no other column reaches the scan."""
    n = F.col("p_size")
    names = F.create_map(F.lit("de"), F.when(n % 2 == 0, F.concat(F.lit("Das "), "p_name")), F.lit("fr"), F.when(n % 3 == 0, F.concat(F.lit("Le "), "p_name")), F.lit("it"), F.col("p_name"))
    layer = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), names.alias("names"), F.col("p_type").alias("parent"), "p_brand")
    f = listing.features(layer, F.col("p_brand") < "Brand#3", ["de", "fr"])
    return f.select("code", "name", F.try_element_at("names", F.lit("de")).alias("de"), F.size("names").alias("names"), "parent")


@query("""
SELECT s_suppkey AS id, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, n_name, 'unknown') AS source, 'CC0' AS licence
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3""")
def provenance_defaults(spark, sf_dir):
    """A record's own source, else its data set's, else a constant; what neither tells is a constant."""
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("source"))
    return layers.provenance(s, {"source": "unknown", "licence": "CC0"}, n, "s_nationkey").drop("s_nationkey")


@query("""
WITH c AS (SELECT p_brand AS file, p_size AS depth, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Countries of ' || p_type WHEN 2 THEN p_type ELSE '' END AS area,
  CASE p_partkey % 4 WHEN 0 THEN 'Category:Maps of ' || p_name || ' (x)' WHEN 1 THEN 'Blank maps of Countries of ' || p_type WHEN 2 THEN 'SVG maps of ' || p_type || ' by User:Z' ELSE 'Maps by country' END AS category FROM part)
SELECT file, max({'a': area NOT LIKE 'Countries of %', 'b': length(area), 'c': depth, 'd': area, 'e': category}).d AS area FROM c WHERE area <> '' GROUP BY file""")
def best_area(spark, sf_dir):
    k = F.col("p_partkey") % 4
    category = F.when(k == 0, F.concat(F.lit("Category:Maps of "), "p_name", F.lit(" (x)"))).when(k == 1, F.concat(F.lit("Blank maps of Countries of "), "p_type"))
    category = category.when(k == 2, F.concat(F.lit("SVG maps of "), "p_type", F.lit(" by User:Z"))).otherwise("Maps by country")
    return listing.best_areas(table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), category.alias("category"), F.col("p_size").alias("depth")))


@query("""
WITH f AS (SELECT doc_id, n_chars % 50 AS usages, md5(text) AS hash, n_chars < 100 AS issue FROM documents)
SELECT count(*) AS files, count(*) FILTER (usages > 0) AS used, sum(usages)::BIGINT AS usages, count(*) FILTER (issue) AS issues,
  (SELECT count(*) FROM (SELECT hash FROM f WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1)) AS duplicate_groups FROM f""")
def catalogue_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return listing.totals(d.select((F.col("n_chars") % 50).alias("usages"), F.md5("text").alias("hash"), (F.col("n_chars") < 100).alias("issue")))
