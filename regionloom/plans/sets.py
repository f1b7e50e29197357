"""Queries of the catalogue operators: differences, status, duplicates, usage, credits, eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog as C
from ..operators import graph
from ..session import table
from .registry import query


@query("""
WITH a AS (SELECT p_name, p_brand, p_type FROM part WHERE p_retailprice < 1500), b AS (SELECT p_name, p_brand, p_type FROM part WHERE p_retailprice >= 1200)
SELECT 'removed' AS side, * FROM a WHERE (p_name, p_brand, p_type) NOT IN (SELECT (p_name, p_brand, p_type) FROM b)
UNION ALL SELECT 'added', * FROM b WHERE (p_name, p_brand, p_type) NOT IN (SELECT (p_name, p_brand, p_type) FROM a)""")
def set_difference(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cols = ["p_name", "p_brand", "p_type"]
    gone, new = C.set_difference(p.where("p_retailprice < 1500").select(*cols), p.where("p_retailprice >= 1200").select(*cols), C.record_key(cols))
    return gone.select(F.lit("removed").alias("side"), *cols).unionByName(new.select(F.lit("added").alias("side"), *cols))


_STATUS = """
WITH d AS (SELECT doc_id, sha1(text) AS h FROM documents),
l AS (SELECT doc_id AS name, h AS hash FROM d),
hist AS (SELECT doc_id AS name, h AS hash, 0 AS age FROM d WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, h, 1 FROM d WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, 'x' || h, 0 FROM d WHERE doc_id % 5 IN (1, 2)),
cur AS (SELECT doc_id AS title, h AS hash FROM d WHERE doc_id % 5 = 0),
nw AS (SELECT name, arg_min(hash, age) AS newest FROM hist GROUP BY name)
SELECT l.name, CASE WHEN nw.newest = l.hash THEN 'current'
  WHEN EXISTS (SELECT 1 FROM hist WHERE hist.name = l.name AND hist.hash = l.hash) THEN 'older'
  WHEN l.hash IN (SELECT hash FROM cur) THEN 'elsewhere' WHEN nw.newest IS NOT NULL THEN 'changed' ELSE 'new' END AS status
FROM l LEFT JOIN nw USING (name)"""


def _status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.sha1_hex(F.col("text")).alias("h"))
    k = F.col("doc_id") % 5
    local = d.select(F.col("doc_id").alias("name"), F.col("h").alias("hash"))
    history = d.where(k == 0).select(F.col("doc_id").alias("name"), F.col("h").alias("hash"), F.lit(0).alias("age"))
    history = history.unionByName(d.where(k == 1).select(F.col("doc_id").alias("name"), F.col("h").alias("hash"), F.lit(1).alias("age")))
    history = history.unionByName(d.where(k.isin(1, 2)).select(F.col("doc_id").alias("name"), F.concat(F.lit("x"), "h").alias("hash"), F.lit(0).alias("age")))
    current = d.where(k == 0).select(F.col("doc_id").alias("title"), F.col("h").alias("hash"))
    return C.publication_status(local, history, current)


@query(_STATUS)
def publication_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status")
def status_counts(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT doc_id AS id, sha1(text) AS h FROM documents), g AS (SELECT h, min(id) AS representative, count(*) AS copies FROM d GROUP BY h HAVING count(*) > 1)
SELECT id, representative, copies FROM d JOIN g USING (h)""")
def duplicate_hash_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.sha1_hex(F.col("text")).alias("h"))
    return C.duplicate_classes(d, "h")


_SIMILAR = """
WITH w AS (SELECT p_partkey AS id, p_brand AS area, sha1(p_type) AS hash, (p_size % 10 + 10) / 10.0::DOUBLE AS ratio,
    list_sort(list_filter(regexp_extract_all(lower('Map of ' || p_name), '[a-z0-9]+'), lambda x: x NOT IN ('map', 'of', 'the', 'a'))) AS ws FROM part),
f AS (SELECT area, array_to_string(ws, ' ') AS name_key, hash, ratio, min(id) AS id FROM w GROUP BY ALL),
pr AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.area = b.area AND a.name_key = b.name_key AND a.id < b.id AND a.hash <> b.hash
  AND abs(a.ratio - b.ratio) / greatest(a.ratio, b.ratio) <= 0.08)
"""


def _similar(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("area"), S.sha1_hex(F.col("p_type")).alias("hash"),
                     ((F.col("p_size") % 10 + 10) / 10.0).alias("ratio"), S.name_key(F.concat(F.lit("Map of "), "p_name", F.lit(".svg"))).alias("name_key"))
    return C.similar_pairs(files)


@query(_SIMILAR + "SELECT a, b FROM pr")
def duplicate_name_pairs(spark, sf_dir):
    return _similar(spark, sf_dir)


@query(_SIMILAR + "SELECT id, list_sort(list_distinct(list(o))) AS links FROM (SELECT a AS id, b AS o FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY id")
def duplicate_links(spark, sf_dir):
    return C.link_lists(_similar(spark, sf_dir))


@query("SELECT user_id, count(DISTINCT (event_type, value)) AS usage_count FROM events GROUP BY user_id")
def usage_distinct(spark, sf_dir):
    return C.usage_counts(table(spark, sf_dir, "events"), "user_id", ["event_type", "value"])


@query("SELECT user_id, count(DISTINCT (event_type, value)) AS usage_count FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 10")
def top_leaders(spark, sf_dir):
    return C.leaders(C.usage_counts(table(spark, sf_dir, "events"), "user_id", ["event_type", "value"]), "user_id")


_OFFICIAL = """
WITH land AS (SELECT c_nationkey AS old, c_mktsegment || '/' || o_orderpriority AS new, sum(round(o_totalprice)::BIGINT) AS land
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT *, land / sum(land) OVER (PARTITION BY old)::DOUBLE AS share FROM land)
"""


def _official(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    land = j.select(F.col("c_nationkey").alias("old"), F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("new"), F.round("o_totalprice").cast("long").alias("land"))
    return C.official_crosswalk(land, 0.04)


@query(_OFFICIAL + """SELECT old AS "from", new AS "to", round(share / sum(share) OVER (PARTITION BY old), 6) AS weight FROM s WHERE share >= 0.04""")
def official_crosswalk(spark, sf_dir):
    j = _official(spark, sf_dir)
    return j.select(F.col("from").cast("int").alias("from"), "to", "weight")


@query("SELECT count(*) AS rows, count(DISTINCT p_brand) FILTER (p_brand <> 'Brand#1') AS changed FROM part")
def crosswalk_metadata(spark, sf_dir):
    return C.crosswalk_metadata(table(spark, sf_dir, "part").select(F.col("p_brand").alias("from"), F.lit("Brand#1").alias("to")))


@query("""
SELECT o_custkey, string_agg(o_orderpriority, ' · ' ORDER BY p, o_orderpriority) AS credits
FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS p FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def credits_ordered(spark, sf_dir):
    return C.ordered_credits(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS joined,
  CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS single, bool_or(o_totalprice > 400000) AS any_flag
FROM orders GROUP BY o_custkey""")
def provenance_merge(spark, sf_dir):
    return C.merged_provenance(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 400000)


@query("""
WITH e AS (SELECT doc_id AS id, n_chars AS bytes, doc_id // 3 AS mtime, sum(n_chars) OVER () AS total FROM documents),
r AS (SELECT *, sum(bytes) OVER (ORDER BY mtime DESC, id DESC) AS run FROM e)
SELECT id, bytes, mtime FROM r WHERE total > 1000000 AND run > 0.8 * 1000000""")
def lru_eviction(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("bytes"), F.floor(F.col("doc_id") / 3).cast("long").alias("mtime"))
    return C.evict(d, 1_000_000)


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_output_names(spark, sf_dir):
    return C.duplicate_names(table(spark, sf_dir, "part"), "p_name")


@query("""
SELECT s_suppkey, concat_ws('; ', CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_nationkey > 12 THEN 'east' END, CASE WHEN s_suppkey % 2 = 0 THEN 'even' END) AS flags FROM supplier""")
def issue_flags(spark, sf_dir):
    flags = {"negative": F.col("s_acctbal") < 0, "east": F.col("s_nationkey") > 12, "even": F.col("s_suppkey") % 2 == 0}
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.flags_text(flags).alias("flags"))


_LINKS = """
WITH RECURSIVE n AS (SELECT 'N' || n_nationkey AS child, CASE WHEN n_nationkey = 0 THEN 'root' ELSE 'N' || (n_nationkey // 2) END AS parent FROM nation
  UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey // 3) FROM nation WHERE n_nationkey > 2),
links AS (SELECT DISTINCT * FROM n WHERE child <> parent),
walk AS (SELECT 'root' AS category, 0 AS d UNION SELECT l.child, w.d + 1 FROM walk w JOIN links l ON l.parent = w.category WHERE w.d < 40)
"""


def _links(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("N"), c.cast("long").cast("string"))
    a = n.select(F.when(k == 0, "root").otherwise(name(F.floor(k / 2))).alias("parent"), name(k).alias("child"))
    b = n.where(k > 2).select(name(F.floor(k / 3)).alias("parent"), name(k).alias("child"))
    return a.unionByName(b).where("parent <> child").distinct()


@query(_LINKS + "SELECT category, min(d)::INT AS level FROM walk GROUP BY category")
def category_tree(spark, sf_dir):
    return graph.category_tree(_links(spark, sf_dir), "root")


@query(_LINKS + "SELECT category, max(d)::INT AS depth FROM walk GROUP BY category")
def category_depth(spark, sf_dir):
    return graph.longest_depth(_links(spark, sf_dir), "root")


@query("""
SELECT event_id, sha1(event_type || chr(31) || CASE WHEN event_id % 3 = 0 THEN chr(1) ELSE coalesce(props, chr(1)) END || chr(31) || user_id::VARCHAR) AS key FROM events""")
def cache_keys(spark, sf_dir):
    parts = [F.col("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("props")), F.col("user_id").cast("string")]
    return table(spark, sf_dir, "events").select("event_id", S.cache_key(parts).alias("key"))
