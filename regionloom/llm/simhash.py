"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most t bits differ in at most t // k bits on one of k blocks.
On each block the anchors are the words of a covering code: a perfect Hamming code times all words on
the other bits, which has covering radius R = 1. Every fingerprint is at home at its nearest anchor
(distance at most R) and is replicated to every anchor within R + t // k. So for any linked pair the
home anchor of one also holds the other, and comparing homes with all others per anchor loses no link.
A single code over all 64 bits would need far more replicas: within R + 4 there are at least
(64/R)^4 / 24 times as many anchors.

Scale. Equal fingerprints are merged first, so a group of copies is one row. `covering` picks the blocks
by the number of distinct fingerprints: fewer and longer blocks have more anchors, hence fewer rows at
each, but take more replicas; whatever it picks, the links are the same. An anchor with more than
`BLOCK_ROWS` rows is cut into chunks of homes and of visitors, each pair of chunks a group of its own. A
group yields links that span what it connects rather than all its pairs. Links, components and
fingerprints stay distributed.

Edge cases. A text without words has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle. A null id counts as the largest id and is returned as null; ids must be
integers (or text of them). Rows that repeat share fingerprint and component. An empty table gives an
empty result. Result columns replace input columns of the same name; other columns are kept, whatever
their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table
from .components import components

SHINGLE = 4
THRESHOLD = 4
REPLICA_COST = 60  # of making and moving a replica, in comparisons
BLOCK_ROWS = 4096
SEED = 42
_LAST = (1 << 63) - 1
_PAIRS = 1 << 21


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included: majority bits of XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII blanks, A-Z
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    total, ones = n - shingle + 1, np.zeros(64, np.int64)
    for a in range(0, total, 1 << 15):
        b = min(total, a + (1 << 15))
        parts = [line[s:e] for s, e in zip(starts[a:b], ends[a + shingle - 1 : b + shingle - 1])]
        h = np.array(list(map(xxh64_intdigest, parts, repeat(SEED))), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`docs` without text, plus fp (the fingerprint's 64 bits as a long)."""
    keep = [c for c in docs.columns if c not in ("text", "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or "", shingle) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())]))


def checks(bits: int) -> int:
    """Parity checks of the longest Hamming code (2^checks - 1 bits) that fits a block."""
    return (bits + 1).bit_length() - 1


def split(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of so many blocks of nearly equal length, the last ones longer."""
    size, more = divmod(bits, blocks)
    lengths = [size + (i >= blocks - more) for i in range(blocks)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


def replica_count(bits: int, reach: int) -> float:
    """Anchors within `reach` of a word, on average."""
    return sum(comb(bits, k) for k in range(reach + 1)) / (1 << checks(bits))


def covering(nodes: int, threshold: int = THRESHOLD, bits: int = 64) -> list[tuple[int, int]]:
    """The blocks that cost the least for so many distinct fingerprints."""

    def cost(blocks: list[tuple[int, int]]) -> float:
        each = [replica_count(n, 1 + threshold // len(blocks)) for _, n in blocks]
        return sum(r * (REPLICA_COST + nodes / (1 << n - checks(n))) for r, (_, n) in zip(each, blocks))

    return min((split(bits, k) for k in (4, 3, 2)), key=cost)


def masks(bits: int, reach: int) -> list[list[tuple[int, bool]]]:
    """By syndrome: the error masks of weight `reach` at most that lead to an anchor, and which is home's."""
    coded = (1 << checks(bits)) - 1
    out: list[list[tuple[int, bool]]] = [[] for _ in range(coded + 1)]
    for weight in range(reach + 1):
        for at in combinations(range(bits), weight):
            syndrome = 0
            for i in at:
                syndrome ^= i + 1 if i < coded else 0
            home = weight == 0 or weight == 1 and at[0] < coded
            out[syndrome].append((sum(1 << i for i in at), home))
    return out


def syndrome(block: Column, bits: int) -> Column:
    parts = []
    for j in range(checks(bits)):
        mask = sum(1 << i for i in range((1 << checks(bits)) - 1) if (i + 1) >> j & 1)
        parts.append(F.shiftleft(F.bit_count(block.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), j))
    return sum(parts[1:], parts[0])


def near_anchors(block: Column, bits: int, reach: int) -> Column:
    """array<struct<mask, home>> of the anchors within `reach` of a block's bits: anchor = block xor mask."""
    found = [[{"mask": m, "home": h} for m, h in row] for row in masks(bits, reach)]
    table = F.from_json(F.lit(json.dumps(found)), "array<array<struct<mask:bigint,home:boolean>>>")
    return F.element_at(table, syndrome(block, bits) + 1)


def replicas(nodes: DataFrame, threshold: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """(anchor, fp, node, home): each fingerprint at every anchor within reach."""
    out = None
    for k, (first, bits) in enumerate(blocks):
        block = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        near = F.explode(near_anchors(block, bits, 1 + threshold // len(blocks))).alias("near")
        rows = nodes.select("fp", "node", block.alias("block"), near)
        rows = rows.select(
            F.col("block").bitwiseXOR(F.col("near.mask")).bitwiseOR(F.lit(k << 40)).alias("anchor"), "fp", "node", F.col("near.home").alias("home")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _chunked(rows: DataFrame, limit: int) -> DataFrame:
    """`rows` plus i, j and visit: anchors over `limit` rows are cut into limit x limit groups."""
    crowd = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
    crowd = crowd.where(F.col("n") > limit).select(
        "anchor", F.ceil(F.col("homes") / limit).cast("int").alias("s"), F.ceil(F.col("n") / limit).cast("int").alias("t")
    )
    r = rows.join(crowd, "anchor", "left")
    spread = F.xxhash64("fp")
    everywhere = F.when(
        F.col("t").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("home"), F.lit(True).alias("visit")))
    ).otherwise(
        F.concat(
            F.when(
                F.col("home"),
                F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.struct(F.pmod(spread, F.col("s")).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("home"), F.lit(False).alias("visit"))),
            ).otherwise(F.array().cast("array<struct<i:int,j:int,home:boolean,visit:boolean>>")),
            F.transform(F.sequence(F.lit(0), F.greatest("s", F.lit(1)) - 1), lambda i: F.struct(i.alias("i"), F.pmod(spread, F.col("t")).cast("int").alias("j"), F.lit(False).alias("home"), F.lit(True).alias("visit"))),
        )
    )
    return r.withColumn("g", F.explode(everywhere)).select("anchor", "g.i", "g.j", "fp", "node", "g.home", "g.visit")


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reached) with the components of the edges (u, v)."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _links(threshold: int):
    """A function over sorted Arrow batches: per (anchor, i, j), homes against visitors."""

    def compare(g: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, visit: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(~visit, kind="stable")
        order = order[np.argsort(g[order], kind="stable")]  # visitors of a group first
        g, fp, node, home, visit = g[order], fp[order], node[order], home[order], visit[order]
        first = np.searchsorted(g, g)
        visitors = np.zeros(len(g) + 1, np.int64)
        np.cumsum(visit, out=visitors[1:])
        last = np.searchsorted(g, g, side="right")
        count = visitors[last] - visitors[first]
        homes = np.flatnonzero(home)
        homes = homes[count[homes] > 0]
        done = np.concatenate([[0], np.cumsum(count[homes])])
        a = 0
        while a < len(homes):
            b = max(a + 1, int(np.searchsorted(done, done[a] + _PAIRS, side="right")) - 1)
            h = homes[a:b]
            x = np.repeat(h, count[h])
            y = np.arange(len(x)) - np.repeat(done[a:b] - done[a], count[h]) + first[x]
            near = (np.bitwise_count(fp[x] ^ fp[y]) <= threshold) & (node[x] != node[y])
            if near.any():
                yield spanning(node[x[near]], node[y[near]])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []

        def take(cols: list[np.ndarray]) -> None:
            g = np.cumsum(np.concatenate([[0], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])]))
            for a, b in compare(g, cols[3].view(np.uint64), *cols[4:]):
                u.append(a)
                v.append(b)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                take([c[:cut] for c in cols])
            if sum(map(len, u)) > 1 << 20:
                u, v = ([x] for x in spanning(np.concatenate(u), np.concatenate(v)))
        if held is not None:
            take(held)
        if u:
            a, b = spanning(np.concatenate(u), np.concatenate(v))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    return run


def links(nodes: DataFrame, threshold: int, blocks: list[tuple[int, int]], limit: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): links that span every group of `nodes` (fp, node; fp distinct) within `threshold` bits."""
    rows = _chunked(replicas(nodes, threshold, blocks), limit)
    group = ["anchor", "i", "j"]
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links(threshold), "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, limit: int = BLOCK_ROWS, blocks: int | None = None
) -> DataFrame:
    """`docs` without text, plus fp and component_id (the smallest doc_id that links reach).

    `blocks` fixes the number of blocks; otherwise the number of fingerprints decides.
    """
    keep = [c for c in docs.columns if c not in ("text", "fp", "component_id")]
    slim = docs.select(F.struct(*keep).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"))
    prints = materialize(fingerprints(slim, shingle), "simhash")
    # a node is its fingerprint: rows without an id share no node, and the smallest id of a component comes last
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("id")).select("fp", F.col("fp").alias("node"), "id"), "simhash-nodes")
    cover = split(64, blocks) if blocks else covering(nodes.count(), threshold)
    found = components(links(nodes.select("fp", "node"), threshold, cover, limit))
    grouped = nodes.join(found, "node", "left").select("fp", "id", F.coalesce("component", "node").alias("c"))
    low = grouped.groupBy("c").agg(F.min("id").alias("low"))
    known = grouped.join(low, "c").select("fp", F.when(F.col("low") != _LAST, F.col("low")).alias("component_id"))
    return prints.join(known, "fp").select("row.*", "fp", "component_id")


def op6_simhash_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
