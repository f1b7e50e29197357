"""Queries of the code operators: reshape, match, hints, lookups, units, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import codes, resolve, units
from ..operators import reshape as R
from ..session import table
from .registry import query

#: One row per case: rename, merge, weighted split, split without weights, absent (5), lone weights, repeats.
_CROSSWALK = [
    ("0", "A0", None), ("1", "A1", None), ("2", "A1", 1.0), ("3", "A3a", 0.25), ("3", "A3b", 0.75), ("4", "A4a", None), ("4", "A4b", None),
    ("6", "A6", 0.5), ("7", "A7", 0.9995), ("8", "A8", None), ("8", "A8", None), ("9", "A9a", 0.4), ("9", "A9b", 0.5),
    *[(str(n), f"R{n % 5}", None) for n in range(10, 20)], *[(str(n), t, w) for n in range(20, 23) for t, w in (("S0", 0.5), ("S1", 0.3), ("S2", 0.2))],
]
_VALUES = ", ".join(f"({i}, '{a}', '{b}', {'NULL::DOUBLE' if w is None else repr(w) + '::DOUBLE'})" for i, (a, b, w) in enumerate(_CROSSWALK))

_BASE = f"""
WITH cw(pos, f, t, w) AS (VALUES {_VALUES}),
data AS (
  SELECT c_nationkey::VARCHAR AS f, c_mktsegment, sum(o_totalprice) AS value, count(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
st AS (SELECT f, count(*) AS n, count(w) AS nw, sum(w) AS sw, min(w) AS w1, string_agg(t, ' ' ORDER BY pos) AS targets FROM cw GROUP BY f),
j AS (
  SELECT data.*, st.n, st.targets,
    CASE WHEN st.n IS NULL THEN '{{missing}}'
         WHEN st.n = 1 AND (w1 IS NULL OR abs(w1 - 1) < 1e-6) THEN 'direct'
         WHEN nw < n THEN '{R.NO_WEIGHTS}'
         WHEN abs(sw - 1) > 1e-3 THEN '{R.BAD_SUM}' ELSE 'weighted' END AS outcome
  FROM data LEFT JOIN st USING (f)),
moved AS (
  SELECT coalesce(cw.t, j.f) AS code, value * CASE WHEN outcome = 'direct' THEN 1.0::DOUBLE ELSE cw.w END AS value,
         orders * CASE WHEN outcome = 'direct' THEN 1.0::DOUBLE ELSE cw.w END AS orders
  FROM j LEFT JOIN cw ON j.f = cw.f WHERE outcome IN ('direct', 'weighted'))
"""


def _crosswalk(spark):
    rows = [(i, *r) for i, r in enumerate(_CROSSWALK)]
    return spark.createDataFrame(rows, "pos int, `from` string, `to` string, weight double")


def _sales(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_nationkey").cast("string").alias("code"), "c_mktsegment")
    return g.agg(F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).cast("double").alias("orders")).drop("c_mktsegment")


def _rounded(df):
    return df.select("code", F.round("value", 4).alias("value"), F.round("orders", 6).alias("orders"))


@query(_BASE.format(missing="direct") + "SELECT code, round(sum(value), 4) AS value, round(sum(orders), 6) AS orders FROM moved GROUP BY code")
def reshape_values(spark, sf_dir):
    return _rounded(R.reshape(_sales(spark, sf_dir), ["value", "orders"], _crosswalk(spark)).rows)


@query(_BASE.format(missing=R.NO_TARGET) + "SELECT code, round(sum(value), 4) AS value, round(sum(orders), 6) AS orders FROM moved GROUP BY code")
def reshape_complete(spark, sf_dir):
    return _rounded(R.reshape(_sales(spark, sf_dir), ["value", "orders"], _crosswalk(spark), complete=True).rows)


@query(_BASE.format(missing=R.NO_TARGET) + """SELECT f AS "from", coalesce(targets, '') AS targets, outcome AS reason, count(*) AS n_rows
FROM j WHERE outcome NOT IN ('direct', 'weighted') GROUP BY ALL""")
def reshape_conflicts(spark, sf_dir):
    return R.reshape(_sales(spark, sf_dir), ["value"], _crosswalk(spark), complete=True).conflicts


@query(_BASE.format(missing="direct") + """SELECT count(*) FILTER (outcome = 'direct') AS direct, count(*) FILTER (outcome = 'weighted') AS weighted,
count(*) FILTER (outcome NOT IN ('direct', 'weighted')) AS conflicts FROM j""")
def reshape_summary(spark, sf_dir):
    return R.reshape(_sales(spark, sf_dir), ["value"], _crosswalk(spark)).summary


@query("""
SELECT CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END AS code, round(sum(p_size::DOUBLE), 6) AS p_size, round(sum(p_retailprice), 4) AS p_retailprice
FROM part GROUP BY 1""")
def reshape_two_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = part.select(F.col("p_size").cast("string").alias("code"), F.col("p_size").cast("string").alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"), "p_name")
    sizes = part.select(F.col("p_size").cast("string").alias("from"), F.when(F.col("p_size") < 10, "small").otherwise("large").alias("to")).distinct()
    out = R.reshape_table(text, "code", ["p_size", "p_retailprice"], sizes.withColumn("weight", F.lit(None).cast("double"))).rows
    return out.select("code", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"))


@query("""
SELECT 'code,orders' AS header, c_nationkey::VARCHAR || ',' || count(*)::VARCHAR AS line
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def reshaped_csv(spark, sf_dir):
    none = spark.createDataFrame([], "`from` string, `to` string, weight double")
    result = R.reshape(_sales(spark, sf_dir), ["orders"], none)
    out = R.reshaped_csv(result, "code", ["orders"])
    return out.select(F.lit(out.columns[0]).alias("header"), F.col(f"`{out.columns[0]}`").alias("line"))


@query("""
SELECT p_brand AS "from", p_type AS "to", p_size / 100.0::DOUBLE AS weight FROM part""")
def crosswalk_rows(spark, sf_dir):
    text = table(spark, sf_dir, "part").select("p_brand", "p_type", (F.col("p_size") / 100.0).cast("string").alias("w"))
    return R.crosswalk_rows(text, "p_brand", "p_type", "w")


_MATCH = """
WITH data AS (SELECT DISTINCT 'N' || c_nationkey AS code FROM customer WHERE c_acctbal < 0
              UNION SELECT DISTINCT r_name FROM region WHERE r_regionkey < 3 UNION SELECT 'X1' UNION SELECT 'X2'),
regions AS (SELECT DISTINCT 'N' || n_nationkey AS code FROM nation),
units AS (SELECT 'N' || n_nationkey AS code, r_name AS unit FROM nation JOIN region ON n_regionkey = r_regionkey),
known AS (SELECT code FROM regions UNION SELECT unit FROM units),
m AS (SELECT 'matched' AS kind, code FROM data WHERE code IN (SELECT code FROM known)
  UNION ALL SELECT 'not_on_map', code FROM data WHERE code NOT IN (SELECT code FROM known)
  UNION ALL SELECT 'without_data', code FROM regions WHERE code NOT IN (SELECT code FROM data)
     AND code NOT IN (SELECT code FROM units WHERE unit IN (SELECT code FROM data)))
"""


def _match(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    units_ = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(code.alias("code"), F.col("r_name").alias("unit"))
    owing = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").cast("string").alias("c"))
    data = codes.table_codes(owing, "c", "N").unionByName(region.where("r_regionkey < 3").select(F.col("r_name").alias("code")))
    data = data.unionByName(spark.createDataFrame([("X1",), ("X2",)], "code string"))
    return codes.match_codes(nation.select(code.alias("code")), units_, data)


@query(_MATCH + "SELECT kind, code FROM m")
def match_codes(spark, sf_dir):
    parts = [df.select(F.lit(k).alias("kind"), "code") for k, df in _match(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_MATCH + """, n AS (SELECT count(*) FILTER (kind = 'matched') AS matched, count(*) FILTER (kind = 'not_on_map') AS not_on_map,
count(*) FILTER (kind = 'without_data') AS without_data FROM m)
SELECT *, coalesce(not_on_map / nullif(matched + not_on_map, 0)::DOUBLE, 0) AS missing_share FROM n""")
def match_summary(spark, sf_dir):
    return codes.match_summary(_match(spark, sf_dir))


@query(_MATCH + "SELECT code FROM m WHERE kind = 'without_data'")
def map_without_data(spark, sf_dir):
    return _match(spark, sf_dir)["without_data"]


@query("""
WITH cw AS (SELECT 'by_type' AS crosswalk, p_brand AS f, p_type AS t FROM part UNION ALL SELECT 'by_name', p_type, p_name FROM part),
missing AS (SELECT DISTINCT p_type AS code FROM part UNION SELECT p_brand FROM part WHERE p_size > 25 UNION SELECT p_name FROM part WHERE p_size < 3),
s AS (SELECT crosswalk, code, max(o) AS o, max(n) AS n FROM (
        SELECT crosswalk, f AS code, 1 AS o, 0 AS n FROM cw UNION ALL SELECT crosswalk, t, 0, 1 FROM cw) WHERE code IN (SELECT code FROM missing) GROUP BY ALL)
SELECT crosswalk, CASE WHEN o = 1 THEN 'old-data' ELSE 'new-data' END AS direction, list_sort(list('P-' || code)) AS codes
FROM s WHERE o <> n GROUP BY ALL""")
def crosswalk_hints(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cw = part.select(F.lit("by_type").alias("crosswalk"), F.col("p_brand").alias("from"), F.col("p_type").alias("to"))
    cw = cw.unionByName(part.select(F.lit("by_name").alias("crosswalk"), F.col("p_type").alias("from"), F.col("p_name").alias("to")))
    missing = part.select(F.col("p_type").alias("code")).unionByName(part.where("p_size > 25").select("p_brand")
        .withColumnRenamed("p_brand", "code")).unionByName(part.where("p_size < 3").select(F.col("p_name").alias("code")))
    return codes.crosswalk_hints(missing.select(F.concat(F.lit("P-"), "code").alias("code")), cw, "P-")


_LOOKUP = "WITH k AS (SELECT p_name || ' ' || p_size AS key, min(p_brand) AS value, max(p_brand) AS other FROM part GROUP BY 1) "


def _named_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("key", F.concat_ws(" ", "p_name", "p_size"))


@query(_LOOKUP + "SELECT key, value FROM k WHERE value = other")
def lookup_unambiguous(spark, sf_dir):
    return codes.lookup(_named_parts(spark, sf_dir), "key", "p_brand")[0]


@query(_LOOKUP + "SELECT key FROM k WHERE value <> other")
def lookup_ambiguous(spark, sf_dir):
    return codes.lookup(_named_parts(spark, sf_dir), "key", "p_brand")[1]


@query(_LOOKUP + """SELECT p_partkey, k.value AS code, k.value IS NOT NULL AS matched
FROM part LEFT JOIN k ON p_name || ' ' || p_size = k.key AND k.value = k.other""")
def code_assignment(spark, sf_dir):
    part = _named_parts(spark, sf_dir)
    return codes.assign_codes(part, F.col("key"), codes.lookup(part, "key", "p_brand")[0]).select("p_partkey", "code", "matched")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE 'R-' || n_regionkey END AS parent, r_name AS parent_name
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 4""")
def parent_names(spark, sf_dir):
    names = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value"))
    key = F.col("n_regionkey").cast("string")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, key).otherwise(F.concat(F.lit("R-"), key)).alias("parent"))
    return codes.parent_names(rows, "parent", names, "R-").select("n_nationkey", "parent", "parent_name")


@query("""
SELECT 'R-' || n_regionkey AS parent, min(n_nationkey) AS first_pos FROM nation WHERE n_regionkey >= 2 GROUP BY 1""")
def unmatched_parents(spark, sf_dir):
    names = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("R-"), F.col("n_regionkey").cast("string")).alias("parent"))
    return codes.unmatched_parents(codes.parent_names(rows, "parent", names, "R-"), "parent", "n_nationkey")


@query("""
WITH p AS (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'DEU' ELSE 'XXX' END AS c FROM supplier)
SELECT s_suppkey, CASE WHEN length(c) = 2 THEN upper(c) WHEN c = 'DEU' THEN 'DE' END AS alpha2 FROM p""")
def country_alpha2(spark, sf_dir):
    pairs = spark.createDataFrame([("DEU", "DE"), ("FRA", "FR")], "alpha3 string, alpha2 string")
    k = F.col("s_nationkey") % 3
    rows = table(spark, sf_dir, "supplier").withColumn("c", F.when(k == 0, "fr").when(k == 1, "DEU").otherwise("XXX"))
    return codes.country_alpha2(F.col("c"), pairs, rows).select("s_suppkey", "alpha2")


@query("SELECT count(*) AS splits FROM (SELECT p_brand, lag(p_brand) OVER (ORDER BY p_partkey) AS q FROM part) WHERE p_brand = q")
def split_count(spark, sf_dir):
    return codes.split_count(table(spark, sf_dir, "part").select(F.col("p_brand").alias("from"), F.col("p_partkey").alias("pos")), "pos")


_UNITS = """
WITH u AS (
  SELECT 'N' || s_nationkey AS region, 'U' || (s_suppkey % 4) AS unit, 'Unit ' || (s_suppkey % 4) || '/' || s_suppkey AS name, s_suppkey AS pos
  FROM supplier WHERE s_nationkey < 15
  UNION ALL SELECT 'N99', 'U0', NULL, 1000000000),
f AS (SELECT 'N' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS class,
             r_name AS parent, 'P' || r_regionkey AS parent_name, NULL::VARCHAR AS country, [n_nationkey] AS geometry
      FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def _unit_tables(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_nationkey < 15")
    k = (F.col("s_suppkey") % 4).cast("string")
    rows = s.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("map_id"), F.concat(F.lit("U"), k).alias("data_unit_id"),
                    F.concat(F.lit("Unit "), k, F.lit("/"), F.col("s_suppkey").cast("string")).alias("data_unit_name"), F.col("s_suppkey").alias("pos"))
    rows = units.unit_rows(rows.unionByName(spark.createDataFrame([("N99", "U0", None, 10**9)], rows.schema)))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    features = n.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("class"), F.col("r_name").alias("parent"),
        F.concat(F.lit("P"), F.col("r_regionkey").cast("string")).alias("parent_name"), F.lit(None).cast("string").alias("country"),
        F.array("n_nationkey").alias("geometry"),
    )
    return features, rows


@query(_UNITS + """
SELECT 'unknown' AS finding, region AS id FROM u WHERE region NOT IN (SELECT id FROM f) GROUP BY ALL
UNION ALL SELECT 'overlapping', region FROM u WHERE region IN (SELECT id FROM f) GROUP BY region HAVING count(DISTINCT unit) > 1
UNION ALL SELECT 'unassigned', id FROM f WHERE id NOT IN (SELECT region FROM u)""")
def unit_report(spark, sf_dir):
    features, rows = _unit_tables(spark, sf_dir)
    return units.unit_report(features, rows)


@query(_UNITS + """
SELECT region, list(unit ORDER BY pos, unit) AS units FROM (SELECT region, unit, min(pos) AS pos FROM u GROUP BY ALL) GROUP BY region""")
def unit_assignments(spark, sf_dir):
    return units.assignments(_unit_tables(spark, sf_dir)[1])


@query(_UNITS + """
SELECT f.id, coalesce(a.units, []::VARCHAR[]) AS units FROM f LEFT JOIN (
  SELECT region, list(unit ORDER BY pos, unit) AS units FROM (SELECT region, unit, min(pos) AS pos FROM u GROUP BY ALL) GROUP BY region) a ON f.id = a.region""")
def unit_tags(spark, sf_dir):
    features, rows = _unit_tables(spark, sf_dir)
    return units.tag_units(features, rows).select("id", "units")


@query(_UNITS + """,
fu AS (SELECT region, arg_min(unit, pos) AS unit FROM u GROUP BY region),
un AS (SELECT unit, arg_max(name, pos) AS uname FROM u WHERE name IS NOT NULL GROUP BY unit),
t AS (SELECT f.*, fu.unit FROM f LEFT JOIN fu ON f.id = fu.region)
SELECT unit AS id, coalesce(any_value(uname), unit) AS name, arg_min(class, t.id) AS class,
       CASE WHEN count(DISTINCT parent) = 1 THEN min(parent) END AS parent, CASE WHEN count(DISTINCT parent_name) = 1 THEN min(parent_name) END AS parent_name,
       NULL::VARCHAR AS country, flatten(list(geometry ORDER BY t.id)) AS geometry
FROM t LEFT JOIN un USING (unit) WHERE unit IS NOT NULL GROUP BY unit
UNION ALL SELECT id, name, class, parent, parent_name, country, geometry FROM t WHERE unit IS NULL""")
def unit_dissolve(spark, sf_dir):
    features, rows = _unit_tables(spark, sf_dir)
    return units.dissolve(features, rows)


_FEATURES = """
WITH f AS (
  SELECT n_nationkey::BIGINT AS pos, 'C' || n_nationkey AS id, n_name AS name, ['Land ' || (n_nationkey % 7)] AS names, 'Q' || (100 + n_nationkey) AS wikidata,
         r_name AS country, (n_nationkey * 7 % 11)::DOUBLE AS area
  FROM nation JOIN region ON n_regionkey = r_regionkey),
inputs AS (
  SELECT row_number() OVER (ORDER BY k, i) - 1 AS pos, input FROM (
    SELECT n_nationkey AS k, 0 AS i, ' c' || n_nationkey || ' ' AS input FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT n_nationkey, 1, lower(n_name) || ' (state)' FROM nation WHERE n_nationkey % 5 = 1
    UNION ALL SELECT n_nationkey, 2, 'land ' || (n_nationkey % 9) FROM nation WHERE n_nationkey % 5 = 2
    UNION ALL SELECT n_nationkey, 3, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 3
    UNION ALL SELECT n_nationkey, 4, 'q' || (n_nationkey + 95) FROM nation WHERE n_nationkey % 5 = 4)),
tries AS (SELECT pos, input, 0 AS t, lower(trim(input)) AS key FROM inputs
  UNION ALL SELECT pos, input, 1, lower(trim(regexp_extract(input, '^(.*\\S) \\(.*\\)$', 1))) FROM inputs WHERE regexp_matches(input, '^(.*\\S) \\(.*\\)$'))
"""
_ALIASES = """,
al AS (SELECT lower(trim(id)) AS key, id, 0 AS rank, pos FROM f
  UNION ALL SELECT lower(trim(k)), id, 1, pos FROM (SELECT id, pos, unnest([name, names[1], wikidata]) AS k FROM f)
  UNION ALL SELECT key, id, 2, 0 FROM (SELECT lower(trim(country)) AS key, arg_max(id, area * 1000 - pos) AS id FROM f GROUP BY 1)),
lk AS (SELECT key, arg_min(id, rank * 1000 + pos) AS id FROM al GROUP BY key),
hit AS (SELECT pos, arg_min(id, t) AS id FROM tries JOIN lk USING (key) GROUP BY pos)
"""


def _resolve_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    text = k.cast("string")
    features = n.select(
        k.cast("long").alias("pos"), F.concat(F.lit("C"), text).alias("id"), F.col("n_name").alias("name"),
        F.array(F.concat(F.lit("Land "), (k % 7).cast("string"))).alias("names"), F.concat(F.lit("Q"), (k + 100).cast("string")).alias("wikidata"),
        F.col("r_name").alias("country"), (k * 7 % 11).cast("double").alias("area"),
    )
    said = (
        F.when(k % 5 == 0, F.concat(F.lit(" c"), text, F.lit(" "))).when(k % 5 == 1, F.concat(F.lower("n_name"), F.lit(" (state)")))
        .when(k % 5 == 2, F.concat(F.lit("land "), (k % 9).cast("string"))).when(k % 5 == 3, F.col("r_name")).otherwise(F.concat(F.lit("q"), (k + 95).cast("string")))
    )
    return n.select(k.cast("long").alias("pos"), said.alias("input")), features


@query(_FEATURES + _ALIASES + "SELECT id, min(pos)::BIGINT AS pos FROM hit GROUP BY id")
def resolve_names(spark, sf_dir):
    return resolve.resolve_regions(*_resolve_tables(spark, sf_dir))[0]


@query(_FEATURES + _ALIASES + "SELECT pos::BIGINT AS pos, input FROM inputs WHERE pos NOT IN (SELECT pos FROM hit)")
def resolve_unknown(spark, sf_dir):
    return resolve.resolve_regions(*_resolve_tables(spark, sf_dir))[1]


@query(_FEATURES + """,
nm AS (SELECT lower(trim(id)) AS key, id, 0 AS rank FROM f UNION SELECT lower(trim(k)), id, 1 FROM (SELECT id, unnest([name, names[1], wikidata]) AS k FROM f)),
tr AS (SELECT pos, id, t * 10 + rank AS q FROM tries JOIN nm USING (key)),
cand AS (SELECT DISTINCT pos, id FROM tr QUALIFY q = min(q) OVER (PARTITION BY pos)),
cc AS (SELECT cand.pos, cand.id, f.country FROM cand JOIN f USING (id)),
alone AS (SELECT pos, min(country) AS country FROM cc GROUP BY pos HAVING count(*) = 1),
votes AS (SELECT country, count(*) AS v FROM alone GROUP BY country),
pick AS (SELECT cc.pos, cc.id FROM cc LEFT JOIN votes USING (country) QUALIFY row_number() OVER (PARTITION BY cc.pos ORDER BY coalesce(v, 0) DESC, cc.id) = 1)
SELECT id, min(pos)::BIGINT AS pos FROM pick GROUP BY id""")
def majority_tiebreak(spark, sf_dir):
    return resolve.find_features(*_resolve_tables(spark, sf_dir))[0]


@query("""
WITH whole AS (SELECT r_name AS id, 'region' AS kind, r_regionkey::BIGINT AS pos FROM region),
parts AS (SELECT CASE WHEN n_nationkey = 3 THEN 'ASIA' ELSE n_name END AS id, 'nation' AS kind, n_nationkey::BIGINT AS pos FROM nation),
inputs AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey < 3 THEN r_name ELSE n_name END AS code FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 100, 'ASIA')
SELECT n, code, kind FROM inputs JOIN (SELECT *, 0 AS level FROM whole UNION ALL SELECT *, 1 FROM parts) b ON b.id = code
QUALIFY row_number() OVER (PARTITION BY code ORDER BY level, pos) = 1""")
def compose_levels(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    whole = r.select(F.col("r_name").alias("id"), F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("pos"))
    name = F.when(F.col("n_nationkey") == 3, "ASIA").otherwise(F.col("n_name"))
    parts = n.select(name.alias("id"), F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("pos"))
    said = F.when(F.col("n_nationkey") < 3, F.col("r_name")).otherwise(F.col("n_name"))
    inputs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("n"), said.alias("code"))
    inputs = inputs.unionByName(spark.createDataFrame([(100, "ASIA")], inputs.schema))
    return resolve.compose_levels(whole, parts, inputs).select("n", "code", "kind")


@query("""
SELECT 'S' || s_suppkey AS id, lower('Nation ' || s_nationkey) AS country FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def level_clashes(spark, sf_dir):
    a = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("id"), F.lit("country").alias("class"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("country"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("part").alias("class"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("country"))
    return resolve.level_clashes(a.unionByName(b))


@query("SELECT c_mktsegment AS region, arg_min('D' || (c_custkey % 3), c_custkey) AS source FROM customer GROUP BY 1")
def composite_regions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return resolve.composite_regions(c.select(F.col("c_mktsegment").alias("region"), F.concat(F.lit("D"), (F.col("c_custkey") % 3).cast("string")).alias("source"), F.col("c_custkey").alias("pos")))


@query(_FEATURES + "SELECT id, list_sort(list_distinct([lower(name), lower(names[1]), lower(wikidata)])) AS aliases FROM f")
def alias_sets(spark, sf_dir):
    return resolve.alias_set(_resolve_tables(spark, sf_dir)[1])


@query("""
SELECT 'found' AS kind, n_name AS code FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'missing', 'NOWHERE'""")
def select_regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    wanted = n.where("n_regionkey = 2").select(F.col("n_name").alias("code")).unionByName(spark.createDataFrame([("NOWHERE",)], "code string"))
    kept, missing = resolve.select_regions(n, wanted, "n_name")
    return kept.select(F.lit("found").alias("kind"), F.col("n_name").alias("code")).unionByName(missing.select(F.lit("missing").alias("kind"), "code"))


@query("SELECT n_name AS id FROM nation WHERE n_regionkey <> 1 AND n_name <> 'NATION_0'")
def context_without_subject(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "id")
    return resolve.without_subject(n, n.where("n_regionkey = 1"), "NATION_0").select("id")


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' NA ' WHEN 1 THEN '-99' WHEN 2 THEN '  ' ELSE ' ' || p_brand END AS a,
                  CASE p_partkey % 8 WHEN 0 THEN '' ELSE p_type END AS b FROM part),
m AS (SELECT p_partkey, CASE WHEN trim(a) NOT IN ('', 'NA', '-99') THEN trim(a) END AS a, CASE WHEN trim(b) NOT IN ('', 'NA', '-99') THEN trim(b) END AS b FROM p)
SELECT p_partkey, coalesce(a, b) AS id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' — ' || b ELSE a END AS named FROM m""")
def null_normalised_ids(spark, sf_dir):
    k = F.col("p_partkey")
    a = F.when(k % 4 == 0, " NA ").when(k % 4 == 1, "-99").when(k % 4 == 2, "  ").otherwise(F.concat(F.lit(" "), "p_brand"))
    b = F.when(k % 8 == 0, "").otherwise(F.col("p_type"))
    p = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    return p.select("p_partkey", S.first_meaningful([F.col("a"), F.col("b")]).alias("id"), S.with_note(S.meaningful(F.col("a")), S.meaningful(F.col("b"))).alias("named"))


@query("SELECT DISTINCT c_mktsegment AS region FROM customer")
def distinct_regions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(S.meaningful(F.col("c_mktsegment")).alias("region")).where("region is not null").distinct()


@query("SELECT r_name AS region, list(n_name ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def grouped_features(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("members"))


_TEXTS = r"""
SELECT p_partkey, p_name || ' & <' || p_brand || '> "x"' AS t FROM part"""


@query(f"""WITH p AS ({_TEXTS})
SELECT p_partkey, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, t AS back,
  CASE WHEN regexp_matches(t, '[,"]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell,
  trim(regexp_replace(translate(t, '#<>[]|{{}}/:\\', '-----------'), '\\s+', ' ', 'g')) AS title,
  sha1(t) AS sha1, regexp_replace(t, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM p""")
def text_scalars(spark, sf_dir):
    t = F.concat("p_name", F.lit(" & <"), "p_brand", F.lit('> "x"'))
    p = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    c = F.col("t")
    return p.select("p_partkey", S.xml_escape(c).alias("escaped"), S.xml_unescape(S.xml_escape(c)).alias("back"), S.csv_cell(c).alias("cell"),
                    S.title_name(c).alias("title"), S.sha1_hex(c).alias("sha1"), S.file_safe(c).alias("safe"))


@query("""
SELECT p_partkey, 'Blank map of ' || p_name || ' (' || p_brand || ').svg' AS file_name, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part""")
def manifest_names(spark, sf_dir):
    from pyspark.sql import Window as W

    name = S.fill_template("Blank map of {name} ({code}).svg", {"name": F.col("p_name"), "code": F.col("p_brand")})
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("file_name"))
    return p.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("file_name")))


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal FROM supplier)
SELECT s_suppkey, rtrim(rtrim(printf('%.2f', s_acctbal), '0'), '.') AS two,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Q' || (s_suppkey + 1) END AS wikidata,
  CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 0.5::DOUBLE END AS number,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Nord ' || s_suppkey END AS plain FROM s""")
def number_scalars(spark, sf_dir):
    k = F.col("s_suppkey")
    text = k.cast("string")
    w = F.when(k % 3 == 0, F.concat(F.lit(" q"), (k + 1).cast("string"))).when(k % 3 == 1, F.concat(F.lit("Q0"), text)).otherwise(F.concat(F.lit("P"), text))
    number = F.when(k % 2 == 0, F.concat(text, F.lit(".5"))).otherwise(F.concat(text, F.lit("d")))
    title = F.when(k % 4 == 0, F.concat(F.lit("Nord "), text, F.lit(" (department)"))).otherwise(F.concat(F.lit("Nord "), text))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.fixed(F.col("s_acctbal"), 2).alias("two"), S.wikidata_id(w).alias("wikidata"),
        S.strict_double(number).alias("number"), S.without_disambiguation(title).alias("plain"))
