"""Compare a query's rows with those of its SQL in DuckDB, whatever their order."""

import os

import duckdb
import numpy as np
from regionloom.session import TABLES


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(v) for v in x]
    return x.item() if hasattr(x, "item") else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def assert_same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
