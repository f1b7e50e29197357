"""Prefix trie of conversations: a node for every distinct sequence of first turns.

Conversations are reduced to paths of turn digests (SHA-256 of role and text); equal paths are one path
with its members' number and smallest id before anything is gathered. Paths are then dealt by the digest
of their first turn into buckets of bounded size. Inside `applyInPandas` a bucket's tries are dictionaries
from digest to child, built path by path and summed up by an iterative postorder walk. A first turn with
more than `most` turns below it isn't gathered: its paths are dealt again by their first two turns, and so
on; its node, like the root, is summed up from the tops of the tries below it by partial aggregates.

The digest over the members that end at a node is a digest of a list of any length. Their ids are sorted
by path and id in the shuffle and streamed through the digest, so no list is ever held; only such ids,
not turns, of one path lie in one task.

Turns are ordered by turn (null first), then role and text; null role or text is
empty; repeated rows are turns of their own. Rows without conv_id take no part. Very long texts are only
digested and measured. A conversation may rebuild to no turns: it is a member of the root alone. An empty
table has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, materialize, table

FIRST = 5  # a conversation borrows from the first of its five
BORROWED = 9  # turns borrowed: less than this
BUCKET_TURNS = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, key, size): the turns in order; key: digest of role and text, size: UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text"), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    pos = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)")
    return rows.withColumn("pos", pos).select("conv_id", "pos", key.alias("key"), F.octet_length("text").cast("long").alias("size"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): every conversation, its first h turns taken from the first of its five, h by its id."""
    rows = materialize(positions(turns), "turns")
    first = F.col("conv_id") - F.col("conv_id") % FIRST
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(BORROWED)).cast("int")
    ids = rows.select("conv_id").distinct().select("conv_id", first.alias("first"), h.alias("h"))
    turn = F.struct("pos", "key", "size")
    openings = rows.where((F.col("conv_id") % FIRST == 0) & (F.col("pos") < BORROWED)).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("opening"))  # at most 8 turns
    openings = openings.withColumnRenamed("conv_id", "first")
    own = rows.where(F.col("pos") > h).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own"))
    none = F.array().cast("array<struct<pos:int,key:binary,size:bigint>>")
    found = ids.join(openings, "first", "left").join(own, "conv_id", "left")
    path = F.concat(F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")), F.coalesce("own", none))
    return found.select("conv_id", path.alias("path")).select("conv_id", F.col("path.key").alias("keys"), F.col("path.size").alias("sizes"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path and id: each path's digest over its ids joined by commas."""
    path, digest, out = None, None, []
    for b in batches:
        for p, c in zip(b["path_id"].to_pylist(), b["conv_id"].to_pylist()):
            if p != path:
                if path is not None:
                    out.append((path, digest.hexdigest()))
                path, digest = p, hashlib.sha256(b"%d" % c)
            else:
                digest.update(b",%d" % c)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["path_id", "ends"])
            out = []
    if path is not None:
        out.append((path, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["path_id", "ends"])


def prefix_id(depth: Column) -> Column:
    """A digest of the first `depth` turns."""
    return F.sha2(F.aggregate(F.slice("keys", F.lit(1), depth), F.lit(b""), lambda a, k: F.concat(a, k)), 256)


def paths(convs: DataFrame) -> DataFrame:
    """(path_id, keys, sizes, n, conv_id, ends): each distinct path, its members' number, smallest id and the digest of all their ids."""
    convs = materialize(convs.withColumn("path_id", prefix_id(F.size("keys"))), "paths")
    one = convs.groupBy("path_id").agg(F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    ends = convs.select("path_id", "conv_id").repartition("path_id").sortWithinPartitions("path_id", "conv_id").mapInArrow(_digests, "path_id string, ends string")
    return one.join(ends, "path_id")


def trie_nodes(rows: pd.DataFrame) -> list[tuple]:
    """The nodes of a bucket: rows have `top` (depth of their trie's top), keys, sizes, n, conv_id and ends.

    A node is a list: children by digest, depth, smallest id, members, saved tokens, leaves, digest of the members that
    end there, size of its last text, smallest id of its parent (None at a top).
    """
    root: dict = {}
    for top, keys, sizes, n, conv, ends in zip(rows["top"], rows["keys"], rows["sizes"], rows["n"], rows["conv_id"], rows["ends"]):
        children, node = root, None
        for depth in range(top, len(keys) + 1):
            name = bytes(keys[depth - 1]) if depth > top else (top, *map(bytes, keys[:top]))
            node = children.get(name)
            if node is None:
                node = children[name] = [{}, depth, conv, 0, 0, 0, NOTHING, int(sizes[depth - 1]), None]
            node[2] = min(node[2], conv)
            node[3] += n
            children = node[0]
        node[6] = ends
    out, stack = [], [(node, None, False) for node in root.values()]
    while stack:
        node, parent, done = stack.pop()
        if not done:
            node[8] = parent and parent[2]
            stack.append((node, parent, True))
            stack.extend((child, node, False) for child in node[0].values())
            continue
        below = node[0].values()
        node[5] = sum(c[5] for c in below) or 1
        node[4] = sum(c[4] for c in below) + (node[3] - 1) * node[7]
        out.append((node[1], node[2], node[8], node[3], len(node[0]), node[5], node[4], node[6]))
    return out


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    found = trie_nodes(rows)
    out = pd.DataFrame(found, columns=["depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])
    return out.assign(parent=out["parent"].astype("Int64"))


def trie(turns: DataFrame, most: int = BUCKET_TURNS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    left = materialize(paths(rebuilt(turns)), "distinct").withColumn("above", F.lit(""))
    spine = [left.where("size(keys) = 0").withColumns({"at": F.lit(""), "up": F.lit(None).cast("string")})]  # per depth: paths that end at a node that isn't gathered
    marks = [spark.createDataFrame([("", None, 0)], "at string, up string, size long")]  # per depth: such nodes, their parent, bytes of their last text
    left, built, depth = left.where("size(keys) > 0"), [], 0
    while True:
        depth += 1
        left = left.withColumn("here", prefix_id(F.lit(depth)))
        sizes = left.groupBy("here").agg(F.sum(F.size("keys") + 1).alias("turns"), F.first("above").alias("up"), F.first(F.col("sizes")[depth - 1]).alias("size"))
        large = materialize(sizes.where(F.col("turns") > most).select(F.col("here").alias("at"), "up", "size"), "large")
        some = bool(large.head(1))
        small = left.join(large.select(F.col("at").alias("here")), "here", "left_anti") if some else left
        built.append(small.withColumn("top", F.lit(depth)))
        if not some:
            break
        marks.append(large)
        deeper = materialize(left.join(large.select(F.col("at").alias("here")), "here", "left_semi").drop("above").withColumnRenamed("here", "above"), "deeper")
        spine.append(deeper.where(F.size("keys") == depth).withColumns({"at": F.col("above")}))
        left = deeper.where(F.size("keys") > depth)
    ready = built[0]
    for b in built[1:]:
        ready = ready.unionByName(b)
    total = ready.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    ready = ready.select("top", "above", "keys", "sizes", "n", "conv_id", "ends", F.pmod(F.xxhash64("here"), F.lit(buckets)).cast("int").alias("bucket"))
    nodes = materialize(_with_tops(ready), "nodes")
    tops = nodes.where("parent IS NULL").select(F.col("above").alias("up"), "conv_id", "n_convs", "n_leaves", "saved_tokens")
    return _spined(nodes, tops, spine, marks)


def _with_tops(ready: DataFrame) -> DataFrame:
    """The nodes of all buckets; a top has no parent yet, and `above` names the node that it hangs from."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_build(part).assign(above=above) for above, part in rows.groupby("above")])[list(columns)]

    columns = "depth conv_id parent n_convs n_children n_leaves saved_tokens ends_sha256 above".split()
    return ready.groupBy("bucket").applyInPandas(run, "depth int, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, above string")


def _spined(nodes: DataFrame, tops: DataFrame, spine: list[DataFrame], marks: list[DataFrame]) -> DataFrame:
    """All nodes: those that aren't gathered are summed up from what hangs from them, deepest first."""
    hanging, done = tops, []
    for depth in reversed(range(len(marks))):
        ended = spine[depth].select(F.col("at"), "conv_id", F.col("n").alias("n_convs"), F.col("ends"))
        below = hanging.select(F.col("up").alias("at"), "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(1).alias("child"))
        sums = below.unionByName(ended, allowMissingColumns=True).groupBy("at").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count("child").alias("n_children"),
            F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("below"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved"), F.max("ends").alias("ends"),
        )
        here = sums.join(marks[depth], "at").select(
            "at", "up", F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children", F.greatest("below", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
        )
        here = materialize(here, "spine")
        done.append(here)
        hanging = tops.join(marks[depth - 1].select(F.col("at").alias("up")), "up", "left_semi") if depth else None
        if depth:
            hanging = hanging.unionByName(here.select("up", "conv_id", "n_convs", "n_leaves", "saved_tokens"))
    shown = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + ["ends_sha256"]
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    parents = every.select(F.col("at").alias("above"), F.col("conv_id").alias("hung"))
    root = F.broadcast(parents.where("above = ''"))  # one row
    inner = nodes.where("parent IS NOT NULL").withColumnRenamed("parent", "parent_conv_id").select(*shown)
    hung = nodes.where("parent IS NULL").drop("parent").unionByName(every.withColumnRenamed("up", "above").drop("at"))
    first = hung.where("above = ''").join(root, "above").withColumnRenamed("hung", "parent_conv_id").select(*shown)
    deeper = hung.where("above <> ''").join(parents, "above").withColumnRenamed("hung", "parent_conv_id").select(*shown)
    top = hung.where("above IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*shown)
    return inner.unionByName(first).unionByName(deeper).unionByName(top)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(turn ORDER BY pos) AS turns, ({crc32_sql("any_value(conv_id)::VARCHAR")} % 9)::INT AS h FROM t GROUP BY conv_id),
p AS (SELECT c.conv_id, list_concat(coalesce(o.turns[1:c.h], []), coalesce(c.turns[c.h + 1:], [])) AS path
      FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, path, u.d, path[1:u.d] AS node FROM p, unnest(range(0, len(path) + 1)) AS u(d)),
g AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256,
             CASE WHEN any_value(d) = 0 THEN 0 ELSE (count(*) - 1) * strlen(any_value(node[-1].x)) END AS saved
      FROM m GROUP BY node),
k AS (SELECT node[1:len(node) - 1] AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (node)),
a AS (SELECT node[1:u.d] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM f, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN a USING (node) LEFT JOIN g q ON f.depth > 0 AND q.node = f.node[1:f.depth - 1]
"""
