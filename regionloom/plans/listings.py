"""Queries of text sinks, code lists, town tables, releases and warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, codes, spatial
from ..operators import reshape as R
from ..session import table
from ..sources import layers
from .joins import _BASE, _crosswalk, _sales
from .registry import query
from .shapes import _BOX_SQL, _PAIR_SQL, _boxes, _pairs


@query(_BASE.format(missing=R.NO_TARGET) + """SELECT DISTINCT f || ',' || coalesce(targets, '') || ',' || CASE WHEN contains(outcome, ',') THEN '"' || outcome || '"' ELSE outcome END AS "from,targets,reason"
FROM j WHERE outcome NOT IN ('direct', 'weighted')""")
def conflicts_csv(spark, sf_dir):
    return R.conflicts_csv(R.reshape(_sales(spark, sf_dir), ["value"], _crosswalk(spark), complete=True))


@query(_PAIR_SQL + """, r AS (SELECT id, id_b, round(ov / ar / sum(ov / ar) OVER (PARTITION BY id), 6) AS w FROM p WHERE ov / ar >= 0.05)
SELECT id || ',' || id_b || ',' || regexp_replace(w::VARCHAR, '\\.0$', '') AS "from,to,weight" FROM r""")
def crosswalk_csv(spark, sf_dir):
    pairs, a, b = _pairs(spark, sf_dir)
    rows = spatial.crosswalk_of_all(spatial.overlap_crosswalk(pairs, spatial.box_overlap(), spatial.box_area(), 0.05), a, b)
    return R.crosswalk_csv(rows.select(F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"), "weight"))


@query("SELECT DISTINCT 'US-' || trim(split_part(p_name, ' ', 2)) AS code FROM part WHERE trim(split_part(p_name, ' ', 2)) <> ''")
def listed_codes(spark, sf_dir):
    second = F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("  "))
    return codes.data_codes(None, table(spark, sf_dir, "part").select(second.alias("code")), prefix="US-")


@query(_BOX_SQL + """
w AS (SELECT id, x0, y0, x1 + 6 AS x1, y1 + 6 AS y1 FROM a),
p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))
   / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS share
  FROM w a JOIN w b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
q AS (SELECT *, row_number() OVER (ORDER BY a, b) AS r FROM p WHERE share > 0.01)
SELECT count(*) AS n, coalesce(string_agg(a || '/' || b || ' (' || round(share * 100)::BIGINT || '%)', ', ' ORDER BY r) FILTER (r <= 6), '')
  || CASE WHEN count(*) > 6 THEN ' and ' || (count(*) - 6) || ' more' ELSE '' END AS text FROM q""")
def overlapping_claims(spark, sf_dir):
    """Boxes that are widened until some overlap."""
    boxes = _boxes(spark, sf_dir).withColumn("x1", F.col("x1") + 6).withColumn("y1", F.col("y1") + 6)
    pairs = spatial.self_overlaps(spatial.box_pairs(boxes, boxes, 12.0), spatial.box_overlap(), spatial.box_area(), spatial.box_area("_b"), 0.01)
    return spatial.claims_text(pairs)


@query("""
SELECT c_mktsegment AS dataset, CASE WHEN c_mktsegment LIKE 'B%' THEN 'per region' ELSE arg_min(c_name, c_custkey) END AS release FROM customer GROUP BY c_mktsegment""")
def dataset_releases(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return catalog.releases(c.select(F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("code"), F.col("c_name").alias("release"), F.col("c_mktsegment").startswith("B").alias("per_region")))


@query("""
SELECT 'in/N' || c_nationkey || '-' || c_mktsegment || '.geojson' AS path FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)""")
def wanted_files(spark, sf_dir):
    path = F.concat(F.lit("in/N"), F.col("c_nationkey").cast("string"), F.lit("-"), "c_mktsegment", F.lit(".geojson"))
    wanted = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    return layers.wanted_files(table(spark, sf_dir, "customer").select(path.alias("path")), wanted)


@query("""
SELECT lpad((c_custkey % 97)::VARCHAR, 5, '0') AS town, arg_max(lpad(c_nationkey::VARCHAR, 5, '0'), c_custkey) AS county, arg_max(round(c_acctbal)::BIGINT, c_custkey) AS land
FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 97 <> 0 GROUP BY 1""")
def town_table(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    geoid = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lpad((k % 97).cast("string"), 5, "0"), F.lit(" "))
    land = F.round("c_acctbal").cast("long").cast("string")
    return codes.town_table(c.select(F.col("c_mktsegment").alias("state"), geoid.alias("geoid"), land.alias("land"), "c_custkey"), "BUILDING", "c_custkey")
