"""Target encoding against counting by hand, whatever the split."""

import datetime as dt
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from regionloom.llm import encoding
from regionloom.llm.common import materialize

from ..oracle import assert_same

SCHEMA = "row_id long, t long, fold int, n long, s long, a long, b long"


def history(rows, key):
    out = {}
    for r in rows:
        old = [x for x in rows if x[1] < r[1] and x[2] != r[2] and x[key] == r[key]]
        out[r[0]] = (sum(x[3] for x in old), sum(x[4] for x in old))
    return out


@pytest.mark.parametrize(("span", "hot"), [(40, 10**9), (1 << 24, 10**9), (1 << 24, 20)])
def test_encode(spark, span, hot):
    """Within one block, over many blocks, and with salted columns."""
    rng = random.Random(span + hot)
    rows = [(i, rng.randrange(span), rng.randrange(5), rng.randrange(3), rng.randrange(2), rng.choice([None, 0, 1, 2**62, -1]), 7 if rng.random() < 0.5 else rng.randrange(60)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], rows[0][2], 1, 1, rows[0][5], 7) for i in range(30)]  # ties
    df = materialize(spark.createDataFrame(rows, SCHEMA), "rows")
    got = {r["row_id"]: r for r in encoding.encode(df, ["a", "b"], span, hot=hot).collect()}
    a, b = history(rows, 5), history(rows, 6)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_a"], r["s_a"]) == a[i] and (r["n_b"], r["s_b"]) == b[i]


def test_lower_sums_is_the_sum_of_nodes():
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 1 << encoding.LEAF_BITS, 500))
    fold, n, s = rng.integers(0, 5, 500), rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    got = encoding.lower_sums(np.zeros(500, np.int64), at, fold, n, s, 5)
    for i in range(500):
        old = (at < at[i]) & (fold != fold[i])
        assert (got[0][i], got[1][i]) == (n[old].sum(), s[old].sum())


def shop(spark, lines, sales):
    t = [(i, c, None if m is None else dt.datetime(2024, 3, 31) + dt.timedelta(microseconds=m)) for i, c, m in sales]
    return (
        spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, flag string").withColumn("n", F.lit("mine")),
        spark.createDataFrame(t, "sale_id long, client_id long, sold_at timestamp_ntz").withColumn("t", F.lit(1)),
        spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (None, "z")], "item_id long, kind string"),
        spark.createDataFrame([(1, 5), (2, None)], "vendor_id long, nation_id int"),
        spark.createDataFrame([(1, "s"), (2, "s"), (3, None)], "client_id long, segment string"),
    )


@pytest.mark.parametrize("step", [1, 1000, 1_000_000, 3_600_000_000])
def test_shop_with_nulls_ties_and_repeats(spark, step):
    import duckdb

    rng = random.Random(step)
    sales = [(i, rng.choice([None, -1, 1, 2, 3, 4]), rng.choice([None, *range(8), rng.randrange(60)])) for i in range(60)]
    sales = [(i, c, None if m is None else m * step) for i, c, m in sales]
    lines = [(rng.choice([None, 99, *range(60)]), rng.choice([None, -1, 1, 2, 3, 8]), rng.choice([None, 1, 2, 9]), rng.choice([None, "kept", "returned"])) for _ in range(500)]
    lines += lines[:40] * 2
    tables = shop(spark, lines, sales)
    con = duckdb.connect()
    for name, df in zip(("sale_lines", "sales", "items", "vendors", "clients"), tables):
        con.register("given", df.drop("n", "t").toPandas())  # pandas holds ids with nulls as doubles
        con.execute(f"CREATE TABLE {name} AS SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in df.columns if c.endswith('_id'))}) FROM given")
    assert_same(encoding.target_encode_lines(*tables), con, encoding.OP11_SQL)


def test_empty(spark):
    tables = shop(spark, [], [])
    assert encoding.target_encode_lines(*tables).count() == 0
    assert encoding.target_encode_lines(tables[0], *shop(spark, [], [(1, 1, None)])[1:]).count() == 0
