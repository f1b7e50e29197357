"""Time-ordered target encoding: what earlier rows of other folds say about a row's values.

For every row and key column the history is all rows with the same value, of other folds and of a
strictly earlier time. `encode` sums it over a dyadic tree of time: a node of level j covers 2^j
units, and the time before a probe is the union of the left siblings on the path from its leaf to
the root, logarithmically many.

* Upper levels, whose leaves are blocks of 2^19 units: history is summed per key, fold and node
  (only left children can be asked for), each block that holds a probe explodes its prefix into
  nodes, an equi-join finds them, and their sums per fold are the block's carry.
* Lower levels: rows and carry of one key and block meet in one task, which sums the nodes level by
  level on arrays and adds each node to the leaves right of it.
* Every answer is the sum of all folds minus that of the row's own.

A key is split over as many blocks as its time has, so a key with a third of all rows is many groups.
Where a group of one column may still have more than `HOT` rows, all its column's rows are dealt over
salts as probes only, and its history, summed per unit and fold first (at most 2^19 times the number
of folds rows a block), goes to every salt. Nothing is dropped, sampled or broadcast by size.

Nulls: a null key value is a value of its own; rows without time, and lines without a sale, take no
part. Ties: rows of one time are no history of each other. Repeated rows count as often as they
occur; extra columns are left alone; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, materialize, table

LEAF_BITS = 19
HOT = 2_500_000
TASK_ROWS = 400_000
FOLDS = 5
WEIGHT = 50
START = 500_000  # the rate, in millionths, where nothing is known
GROUP = ("col", "key", "block")
CARRY = 1 << 15  # in a fed row's tag: salt, 8 bits of column, this bit, 15 bits of fold


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as it stands, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.simpleString() == "timestamp":
        return F.unix_micros(c)
    second = (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second


def timed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Rows that have a time, with it in the coarsest unit that loses nothing (s, ms or us) from the first one on; the last one."""
    df = df.withColumn("_us", micros(df, name)).where("_us IS NOT NULL")
    whole = [F.bool_and(F.col("_us") % u == 0) for u in (1_000_000, 1000)]
    low, high, s, ms = df.agg(F.min("_us"), F.max("_us"), *whole).first()
    unit = 1_000_000 if s else 1000 if ms else 1
    t = F.expr(f"(_us - {low or 0}L) div {unit}L")
    return df.withColumn("t", t).drop("_us"), 0 if low is None else (high - low) // unit


def numbered(values: DataFrame) -> DataFrame:
    """The distinct values of a one-column table, each with a long number `no`; nulls have none."""
    name = values.columns[0]
    return materialize(values.where(F.col(name).isNotNull()).distinct().withColumn("no", F.monotonically_increasing_id()), "values")


def _nodes(height: int, probe: bool) -> Column:
    """Heap numbers of a block's ancestors (itself included) that are left children; for a probe, the left siblings of those that are right children."""
    found = []
    for j in range(height):
        at = F.shiftright("block", j)
        found.append(F.when(at.bitwiseAND(F.lit(1).cast("long")) == int(probe), F.lit(1 << (height - j)).cast("long") + at - int(probe)))
    return F.explode(F.array_compact(F.array(*found)))


def carries(blocks: DataFrame, height: int) -> DataFrame:
    """(col, key, block, fold, n, s): for each block of a key what the key's earlier blocks hold, from the tree's nodes."""
    nodes = blocks.select("col", "key", "fold", "n", "s", _nodes(height, False).alias("node")).groupBy("col", "key", "node", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    probes = blocks.select(*GROUP).distinct().select(*GROUP, _nodes(height, True).alias("node"))
    return probes.join(nodes, ["col", "key", "node"]).groupBy(*GROUP, "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def lower_sums(group: np.ndarray, at: np.ndarray, fold: np.ndarray, n: np.ndarray, s: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (group, at): n and s of rows of the group that are earlier and of other folds.

    `at` is the time within the block, or -1 for the group's carry. Level by level, a node's sum goes to all
    leaves below its right sibling.
    """
    carried, groups = at < 0, int(group[-1]) + 1
    base = np.stack([np.bincount(group[carried] * folds + fold[carried], x[carried], groups * folds) for x in (n, s)]).astype(np.int64).reshape(2, groups, folds)
    code = (group << LEAF_BITS) | np.where(carried, 0, at)
    first = np.r_[True, code[1:] != code[:-1]]
    leaf, u = np.cumsum(first) - 1, code[first]
    own = np.stack([np.bincount(leaf * folds + fold, np.where(carried, 0, x), len(u) * folds) for x in (n, s)]).astype(np.int64).reshape(2, len(u), folds)
    before, node = np.zeros_like(own), np.arange(len(u))
    for _ in range(LEAF_BITS):
        if len(u) == groups:
            break  # one node a group: nothing lies to its left
        right = np.r_[False, (u[1:] & 1 == 1) & (u[:-1] == u[1:] - 1)]
        hit = np.flatnonzero(right[node])
        before[:, hit] += own[:, node[hit] - 1]
        up = u >> 1
        first = np.r_[True, up[1:] != up[:-1]]
        own, node, u = np.add.reduceat(own, np.flatnonzero(first), axis=1), (np.cumsum(first) - 1)[node], up[first]
    both = [(before[k].sum(1)[leaf] - before[k][leaf, fold]) + (base[k].sum(1)[group] - base[k][group, fold]) for k in (0, 1)]
    return both[0], both[1]


ANSWER = pa.schema([("row_id", pa.int64()), ("col", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])


def _answers(folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        del found
        tag, key, t, n, s = (rows[c].to_numpy() for c in ("tag", "key", "t", "n", "s"))
        ids, known = rows["row_id"].fill_null(0).to_numpy(), rows["row_id"].is_valid().to_numpy()
        del rows
        order = np.lexsort((t, key, tag >> 16))  # a carry's time is its block's first, and equal times may stand in any order
        tag, key, t = tag[order], key[order], t[order]
        change = np.zeros(len(order), bool)
        for x in (tag >> 16, key, t >> LEAF_BITS):
            change[1:] |= x[1:] != x[:-1]
        at = np.where(tag & CARRY, -1, t & ((1 << LEAF_BITS) - 1))
        n, s = lower_sums(np.cumsum(change), at, tag & (CARRY - 1), n[order], s[order], folds)
        asked = known[order]
        out = pa.table([ids[order][asked], (tag[asked] >> 16 & 255).astype(np.int32), n[asked], s[asked]], schema=ANSWER)
        yield from out.to_batches(max_chunksize=50_000)

    return run


def encode(rows: DataFrame, keys: list[str], last: int, folds: int = FOLDS, hot: int = HOT) -> DataFrame:
    """(row_id, n_<key>, s_<key>, ...) for each row and key column.

    `rows`, a stored table, has row_id (distinct long), t (long, 0 to `last`), fold (0 to folds - 1), n and s (long: what the
    row adds to a history's two sums) and the key columns (long).
    """
    height = (last >> LEAF_BITS).bit_length()
    pairs = F.explode(F.array(*(F.struct((F.lit(2 * i) + F.col(k).isNull().cast("int")).alias("col"), F.coalesce(F.col(k).cast("long"), F.lit(0).cast("long")).alias("key")) for i, k in enumerate(keys))))
    x = rows.select("row_id", "t", F.col("fold").cast("long").alias("fold"), "n", "s", pairs.alias("p"))
    x = x.select("p.col", "p.key", "t", F.shiftright("t", LEAF_BITS).alias("block"), "fold", "n", "s", "row_id")
    blocks = materialize(x.groupBy(*GROUP, "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("rows")), "blocks")
    size = {r["col"]: r["rows"] for r in blocks.groupBy("col").agg((folds * F.max("rows")).alias("rows")).collect()}  # two rows a key column at most
    salts = {c: -(-n // hot) for c, n in size.items() if n > hot}
    count = reduce(lambda found, c: F.when(F.col("col") == c, salts[c]).otherwise(found), salts, F.lit(1))
    every = F.explode(F.sequence(F.lit(0), count - 1)).alias("salt")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

    def fed(df: DataFrame, carry: int = 0) -> DataFrame:
        tag = F.shiftleft(F.shiftleft(F.col("salt").cast("long"), 8) + F.col("col"), 16) + carry + F.col("fold")
        return df.select(tag.alias("tag"), "key", "t", "n", "s", "row_id")

    if salts:
        salted = F.col("col").isin(*salts)
        history = x.where(salted).groupBy("col", "key", "t", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("*", every, none.alias("row_id"))
        asked = x.where(salted).withColumns({"salt": F.pmod(F.xxhash64("row_id"), count), "n": zero, "s": zero})
        feed = fed(x.where(~salted).withColumn("salt", zero)).unionByName(fed(history)).unionByName(fed(asked))
    else:
        feed = fed(x.withColumn("salt", zero))
    if height:
        feed = feed.unionByName(fed(carries(blocks, height).select("*", every, F.shiftleft("block", LEAF_BITS).alias("t"), none.alias("row_id")), CARRY))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * len(keys) // TASK_ROWS)
    feed = feed.repartition(tasks, F.shiftright("tag", 16), "key", F.shiftright("t", LEAF_BITS))
    answers = feed.mapInArrow(_answers(folds), "row_id long, col int, n long, s long").repartition(tasks, "row_id")
    pick = [F.max(F.when(F.shiftright("col", 1) == i, F.col(c))).alias(f"{c}_{k}") for i, k in enumerate(keys) for c in ("n", "s")]
    return answers.groupBy("row_id").agg(*pick)


def rate(n: str, s: str, prior: Column) -> Column:
    """floor((1000000 s + 50 p) / (n + 50)) in longs; p if there is no history."""
    top = F.col(s) * F.lit(1_000_000).cast("long") + prior * F.lit(WEIGHT).cast("long")
    return F.when(F.col(n) < 1, prior).otherwise(F.call_function("div", top, F.col(n) + F.lit(WEIGHT).cast("long")))


def _dimension(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key: the smallest value, as a number if it is text."""
    one = df.select(F.col(key).cast("long").alias(key), value).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    if df.schema[value].dataType.simpleString() != "string":
        return one.withColumn(value, F.col(value).cast("long"))
    return one.join(numbered(df.select(value)), value).select(key, F.col("no").alias(value))


def target_encode_lines(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """Per sale, item and vendor of the lines: own counts, and n and rate of the history by item, vendor and client.

    A sale's own values (client, segment, everything) are encoded once a sale, then travel with its lines. The prior of an
    item's rate is that of its kind, of a vendor's that of its nation, of a client's that of its segment; theirs is the
    rate of all history. Ids without a row in their table, and null values there, share one value.
    """
    returned = F.count_if(F.col("flag") == "returned").alias("s")
    sales, last = timed(sales.select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1).cast("long")).alias("client_id"), "sold_at").where("sale_id IS NOT NULL"), "sold_at")
    lines = lines.select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1).cast("long")).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), "flag").where("sale_id IS NOT NULL")
    sums = lines.groupBy("sale_id").agg(F.count(F.lit(1)).alias("n"), returned)
    fold = F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    sold = sales.select("sale_id", "client_id", "t", fold.alias("fold")).join(sums, "sale_id").join(_dimension(clients, "client_id", "segment"), "client_id", "left")
    sold = materialize(sold.withColumns({"row_id": F.monotonically_increasing_id(), "every": F.lit(0).cast("long")}), "sales")
    told = sold.hint("shuffle_hash").join(encode(sold, ["every", "segment", "client_id"], last), "row_id")
    p = rate("n_every", "s_every", F.lit(START).cast("long"))
    told = told.select("sale_id", "t", "fold", p.alias("p"), "segment", F.col("n_client_id").alias("client_n"), "n_segment", "s_segment", "s_client_id")
    told = told.select("sale_id", "t", "fold", "p", "client_n", rate("client_n", "s_client_id", rate("n_segment", "s_segment", F.col("p"))).alias("client_rate"))
    own = lines.groupBy("sale_id", "item_id", "vendor_id").agg(F.count(F.lit(1)).alias("n"), returned).join(told, "sale_id")
    own = own.join(_dimension(items, "item_id", "kind"), "item_id", "left").join(_dimension(vendors, "vendor_id", "nation_id"), "vendor_id", "left")
    own = materialize(own.withColumn("row_id", F.monotonically_increasing_id()), "lines")
    found = own.hint("shuffle_hash").join(encode(own, ["item_id", "kind", "vendor_id", "nation_id"], last), "row_id")
    return found.select(
        "sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"),
        F.col("n_item_id").alias("item_n"), rate("n_item_id", "s_item_id", rate("n_kind", "s_kind", F.col("p"))).alias("item_rate"),
        F.col("n_vendor_id").alias("vendor_n"), rate("n_vendor_id", "s_vendor_id", rate("n_nation_id", "s_nation_id", F.col("p"))).alias("vendor_rate"),
        "client_n", "client_rate",
    )


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sale lines of the shop."""
    return target_encode_lines(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def _history(name: str, value: str) -> str:
    """SQL: n and s of the rows with the same value that are earlier and of other folds."""
    frame = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    over = [f"OVER (PARTITION BY {value}{more} ORDER BY sold_at {frame})" for more in ("", ", fold")]
    return ", ".join(f"(coalesce(sum({x}) {over[0]}, 0) - coalesce(sum({x}) {over[1]}, 0))::BIGINT AS {name}_{y}" for x, y in (("1", "n"), ("r", "s")))


def _rate(name: str, prior: str) -> str:
    return f"CASE WHEN {name}_n < 1 THEN {prior} ELSE (1000000 * {name}_s + 50 * {prior}) // ({name}_n + 50) END"


OP11_SQL = f"""
WITH s AS (
  SELECT sale_id, coalesce(client_id, -1) AS client_id, sold_at, {crc32_sql("sale_id::VARCHAR")} % 5 AS fold
  FROM sales WHERE sale_id IS NOT NULL AND sold_at IS NOT NULL),
i AS (SELECT item_id, min(kind) AS kind FROM items GROUP BY item_id),
v AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id),
c AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY client_id),
l AS (
  SELECT s.*, coalesce(x.item_id, -1) AS item_id, x.vendor_id, CASE WHEN flag = 'returned' THEN 1 ELSE 0 END AS r, kind, nation_id, segment
  FROM sale_lines x JOIN s USING (sale_id) LEFT JOIN i ON i.item_id = coalesce(x.item_id, -1)
  LEFT JOIN v ON v.vendor_id = x.vendor_id LEFT JOIN c ON c.client_id = s.client_id),
h AS (
  SELECT *, {_history("every", "0")}, {_history("kind", "kind")}, {_history("nation", "nation_id")}, {_history("segment", "segment")},
         {_history("item", "item_id")}, {_history("vendor", "vendor_id")}, {_history("client", "client_id")}
  FROM l),
p AS (SELECT *, {_rate("every", "500000")} AS p FROM h),
q AS (SELECT *, {_rate("kind", "p")} AS kind_p, {_rate("nation", "p")} AS nation_p, {_rate("segment", "p")} AS segment_p FROM p)
SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, sum(r)::BIGINT AS n_returned,
       any_value(item_n) AS item_n, any_value({_rate("item", "kind_p")}) AS item_rate,
       any_value(vendor_n) AS vendor_n, any_value({_rate("vendor", "nation_p")}) AS vendor_rate,
       any_value(client_n) AS client_n, any_value({_rate("client", "segment_p")}) AS client_rate
FROM q GROUP BY sale_id, item_id, vendor_id, client_id, sold_at
"""
