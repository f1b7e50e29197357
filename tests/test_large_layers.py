"""What only shows in layers of some size: grids that run off the globe."""

import duckdb
from pyspark.sql import functions as F
from regionloom.plans import registry

from .oracle import assert_same


def test_layer_of_large_keys(spark, tmp_path):
    path = f"{tmp_path}/supplier.parquet"
    spark.range(1050, 1114).select(F.col("id").alias("s_suppkey")).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert_same(registry.QUERIES["layer_issues"](spark, str(tmp_path)), con, registry.ORACLE_SQL["layer_issues"])


def test_source_of_a_data_set(spark):
    """Before the constant comes what the record's data set tells."""
    from regionloom.sources import layers

    records = spark.createDataFrame([(1, "a", "own"), (2, "a", None), (3, "b", None), (4, None, None)], "id long, k string, source string")
    sets = spark.createDataFrame([("a", "set a")], "k string, source string")
    got = layers.provenance(records, {"source": "none", "licence": "CC0"}, sets, "k").orderBy("id").collect()
    assert [(r["id"], r["source"], r["licence"]) for r in got] == [(1, "own", "CC0"), (2, "set a", "CC0"), (3, "none", "CC0"), (4, "none", "CC0")]
