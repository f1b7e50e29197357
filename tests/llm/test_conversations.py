"""The trie against SQL on hand-made conversations: nulls, ties, repeats, long shared openings, splits."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from regionloom.llm import conversations

from ..oracle import assert_same

SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 400), 150):
        for t in range(rng.choice([1, 2, 3, 12])):
            rows.append((c, rng.choice([None, t, t, 3]), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", "same", "same", "é" * 5, "long " * 3000])))
    rows += [(c, t, "user", f"shared {t}") for c in range(1000, 1200, 5) for t in range(1 + c % 7)]
    rows += rows[:30]
    rows += [(None, 1, "user", "lost")] * 3
    return rows


@pytest.mark.parametrize("most", [3, 40, 20_000])
def test_trie(spark, most):
    df = spark.createDataFrame(made(most), SCHEMA).withColumns({"keys": F.lit(1), "above": F.lit("x"), "n": F.lit(2)})
    con = duckdb.connect()
    con.register("given", df.select("conv_id", "turn", "role", "text").toPandas())
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM given")
    assert_same(conversations.trie(df, most), con, conversations.OP13_SQL)


def test_turnless_and_empty(spark):
    df = spark.createDataFrame([(6, 0, "user", "only")], SCHEMA)  # borrows from 5, which is absent
    assert [tuple(r) for r in conversations.trie(df).collect()] in ([(6, 0, None, 1, 0, 1, 0, conversations.hashlib.sha256(b"6").hexdigest())], [(6, 0, None, 1, 1, 1, 0, conversations.NOTHING), (6, 1, 6, 1, 0, 1, 0, conversations.hashlib.sha256(b"6").hexdigest())])
    assert conversations.trie(df.limit(0)).count() == 0
