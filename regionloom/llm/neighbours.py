"""Approximate nearest neighbours by a hash-prefix forest.

A tree hashes a vector to a string of sign bits of random hyperplanes and keeps the strings sorted, so
the vectors below a prefix are one run of the array. A query descends in all trees to its longest
prefix matches and then ascends in all trees at once: level by level it takes the runs of one bit
less, measures what is new, and stops at the first level x that makes a miss unlikely. For two vectors
at angle a one bit agrees with probability p = 1 - a / pi; one as near as the worst of the answers so
far is missed by all L trees with probability (1 - p^x)^L, and the query stops when that is at most
`miss`. So there is no number of candidates to set: near neighbours stop the ascent early, a cloud
without any structure makes it go on, to all rows at level 0 if it must.

The rows are dealt by their hash over shards of about `shard_rows`, each with a forest of its own, and
the queries over blocks of about `block_rows`; every block of queries meets every shard in one task of
bounded size, whatever the data are like (copies and clusters are spread over the shards), and the best
of all shards are ranked per query. Scores are cosines of the original vectors in double precision.

Rows with equal id and vector count once. An id with several vectors counts by its nearest, as query
and as candidate. Rows without id and vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths never meet. Fewer candidates than asked for:
all of them. Ties go to the smaller id. Extra columns are ignored; an empty table has an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

TREES = 96
BITS = 40
MISS = 0.08
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
FOUND = "query_id long, vec_id long, score double"


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and their lengths (double precision)."""
    v = t["vector"].combine_chunks()
    width = len(v.values) // max(1, len(v)) if len(v) else 0
    v = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), width)
    return t["vec_id"].to_numpy(), v, np.sqrt(np.einsum("ij,ij->i", v, v))


class Forest:
    """Sorted arrays of the hash strings of some vectors, one per tree, in one array: tree number, then the string."""

    def __init__(self, width: int, trees: int = TREES, bits: int = BITS, seed: int = 1):
        self.planes = np.random.default_rng([seed, width]).standard_normal((trees, width, bits))
        self.trees, self.bits = trees, bits
        self.tops = np.arange(trees, dtype=np.int64) << bits

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, rows): the tree's number and the string as one integer."""
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(vectors @ p > 0) @ weights for p in self.planes]) + self.tops[:, None]

    def index(self, vectors: np.ndarray) -> None:
        strings = self.strings(vectors)
        order = np.argsort(strings, axis=1, kind="stable")
        self.rows = order.ravel()
        self.sorted = np.take_along_axis(strings, order, 1).ravel()
        self.n = len(vectors)

    def runs(self, string: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree, from where to where the array agrees with the string on `level` bits."""
        low = string >> (self.bits - level) << (self.bits - level)
        return np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, low + (1 << (self.bits - level)))

    def deepest(self, string: np.ndarray, least: int) -> int:
        """The longest prefix at which the trees hold `least` rows, copies in several trees counted."""
        low, high = 0, self.bits
        while low < high:
            level = (low + high + 1) // 2
            a, b = self.runs(string, level)
            low, high = (level, high) if int((b - a).sum()) >= least else (low, level - 1)
        return low


def stop_level(score: float, trees: int, bits: int, miss: float) -> int:
    """The deepest level at which vectors of this cosine are missed by all trees with probability `miss` at most."""
    p = 1 - math.acos(max(-1.0, min(1.0, score))) / math.pi
    need = 1 - miss ** (1 / trees)  # p^x must be this much
    if p >= 1:
        return bits
    return 0 if p <= 0 else max(0, min(bits, int(math.log(need) / math.log(p))))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of different ids, ties to the smaller id."""
    if len(ids) > 8 * k:
        cut = np.partition(score, len(score) - 4 * k)[len(score) - 4 * k]
        keep = score >= cut
        if len(np.unique(ids[keep])) >= k:
            score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return score[order][first], ids[order][first]


def search(forest: Forest, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, q_id: int, q: np.ndarray, q_length: float, string: np.ndarray, k: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k nearest rows found, the query's own id left out."""
    seen = ids == q_id
    score, best = np.zeros(0), np.zeros(0, np.int64)
    level = forest.deepest(string, k + 1)
    a = b = np.zeros(0, np.int64)
    while True:
        low, high = forest.runs(string, level)
        parts = [(low, high)] if not len(a) else [(low, a), (b, high)]  # only what this level adds
        rows = np.concatenate([forest.rows[x:y] for lo, hi in parts for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist())] or [np.zeros(0, np.int64)])
        rows = np.flatnonzero(np.bincount(rows, minlength=forest.n).astype(bool) & ~seen) if len(rows) else rows
        if len(rows):
            seen[rows] = True
            s = np.einsum("ij,j->i", vectors[rows], q) / (lengths[rows] * q_length)
            score, best = _best(np.r_[score, s], np.r_[best, ids[rows]], k)
        a, b = low, high
        goal = stop_level(score[-1], forest.trees, forest.bits, miss) if len(best) == k else 0
        if level <= goal:
            return score, best
        level -= 1


def _meet(k: int, miss: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, vectors, lengths = _vectors(rows)
            forest = Forest(vectors.shape[1])
            forest.index(vectors)
            q_ids, q, q_lengths = _vectors(queries)
            for i, string in enumerate(forest.strings(q).T):
                score, found = search(forest, ids, vectors, lengths, q_ids[i], q[i], q_lengths[i], string, k, miss)
                out += zip([q_ids[i]] * len(found), found, score)
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: Column, column: str = "embedding", k: int = 5, miss: float = MISS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of `vectors` (vec_id, `column`) that `queries` picks."""
    v = F.col(column).cast("array<double>")
    fit = F.size(v).__gt__(0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & fit)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("width"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = materialize(rows.groupBy("vec_id", "vector", "width").agg(F.max("asks").alias("asks")), "vectors")
    count = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards, blocks = (max(1, -(-c // size)) for c, size in zip(count, (shard_rows, block_rows)))
    deal = F.xxhash64("vec_id", "vector")
    data = rows.select("vec_id", "vector", "width", F.pmod(deal, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = rows.where("asks").select("vec_id", "vector", "width", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64(deal), F.lit(blocks)).cast("int").alias("block"))
    meeting = ("width", "shard", "block")
    found = data.groupBy(*meeting).cogroup(asked.groupBy(*meeting)).applyInArrow(_meet(k, miss), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all other rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
