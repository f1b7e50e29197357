"""SimHash near-dedup by similarity: anchor-point covering, then an exact check of 5-word Jaccard.

A text's fingerprint is the SimHash of its set of word shingles, wide enough for a target recall: of two
sets with Jaccard similarity J a share acos(2J / (1 + J)) / pi of the bits differs. The bits are cut into
blocks. Two sets meet if they differ in at most one bit on some block; there, as in simhash.py, the anchors
are the words of a covering code of radius 1, homes meet all fingerprints within 2. `plan` picks the
blocks' length by the number of texts, so that an anchor holds some 100 to 200 whatever that number, and as
many blocks as bring two sets of similarity 0.8 together with probability `RECALL`; more similar ones meet
more surely.

What meets is checked: by a 64-bit sketch (part of the fingerprint, three deviations beyond 0.8), by sizes
and parity bitmaps (their differing bits are never more than the sets' differing members), and at last by
the sets themselves. So no link is false, up to equal 64-bit hashes of different shingles.

Scale. Equal sets are merged first. At an anchor, a home with up to `FEW` passing partners gives all these pairs; one
with more (many near copies) gives its nearest only and counts as dense. Dense sets alone meet at their anchors
again, with the components found so far, and those that sketches may still link to another component give
all pairs of different components that bitmaps let pass. Only many sets that bitmaps cannot tell from near
copies yield pairs by the square. Anchors of over `LIMIT` rows are cut into chunk pairs. Sets are made again
from the texts of those few documents that are in a pair, and never stored for others.

Edge cases. Texts without words have the empty set and are copies of each other; fewer words than a
shingle are one shingle. Ids play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, spread
from .components import components
from .simhash import near_anchors

SHINGLE = 5
SHARE = (4, 5)  # similarity 0.8 as a fraction, so that all bounds are exact in integers
RECALL = 0.99
LIMIT = 1 << 14
FEW = 8
CHUNK = 4096
SEED = 42
SKETCH = 64


def differing(share: tuple[int, int] = SHARE) -> float:
    """The share of fingerprint bits in which two sets of that similarity differ."""
    j = share[0] / share[1]
    return acos(2 * j / (1 + j)) / pi


def plan(texts: int, share: tuple[int, int] = SHARE, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a block, blocks)."""
    bits = min(30, max(15, round(log2(max(texts, 2)))))
    d = differing(share)
    meet = (1 - d) ** bits + bits * d * (1 - d) ** (bits - 1)
    return bits, ceil(log(1 - recall) / log(1 - meet))


def sketch_limit(share: tuple[int, int] = SHARE) -> int:
    d = differing(share)
    return ceil(SKETCH * d + 3 * sqrt(SKETCH * d * (1 - d)))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending (uint64)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII blanks, A-Z
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    parts = [line[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))


def set_key(members: np.ndarray) -> int:
    """A 64-bit name of a set, signed."""
    from xxhash import xxh64_intdigest

    key = xxh64_intdigest(members.tobytes(), SEED + 1)
    return key - (1 << 64) if key >> 63 else key


def parity(members: np.ndarray) -> bytes:
    """Parity bitmap of 64 bits or the power of two that is at least four bits a member."""
    bits = max(64, 1 << (4 * len(members) - 1).bit_length())
    place = (members >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fingerprint(members: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of hashed members: 0 or 1 for each bit (1 where more than half the members have it)."""
    ones = np.zeros(-(-bits // 64) * 64, np.int64)
    for a in range(0, len(members), 1 << 14):
        part = members[a : a + (1 << 14)]
        for j in range(0, len(ones), 64):
            h = K.mix(part + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            ones[j : j + 64] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return (2 * ones[:bits] > len(members)).astype(np.uint8)


def _prints(shingle: int, bits: int, blocks: int):
    """Columns _id, _th, text to _id, _th, node, size, sketch, blocks, bitmap; the last four only once a task for equal sets."""
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part, keys, sizes, sketches, cut, maps = batch.slice(a, 1024), [], [], [], [], []
                for text in part.column("text"):
                    found = shingles(text.as_py(), shingle)
                    keys.append(set_key(found))
                    if keys[-1] in seen:
                        sizes.append(None), sketches.append(None), cut.append(None), maps.append(None)
                        continue
                    seen.add(keys[-1])
                    if len(seen) > 1 << 20:
                        seen.clear()
                    print_ = fingerprint(found, SKETCH + bits * blocks)
                    sizes.append(len(found))
                    sketches.append(int(np.packbits(print_[:SKETCH], bitorder="little").view(np.int64)[0]))
                    cut.append(print_[SKETCH:].reshape(blocks, bits) @ weights)
                    maps.append(parity(found))
                cols = [part.column("_id"), part.column("_th"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()),
                        pa.array(sketches, pa.int64()), pa.array(cut, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_th", "node", "size", "sketch", "blocks", "bitmap"])
        K.release()

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows that agree in the first `keys` columns; input is sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        new = np.zeros(len(cols[0]) - 1, bool)
        for k in range(keys):
            new |= cols[k][1:] != cols[k][:-1]
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
        size = np.diff(cuts)
        for a, n in zip(cuts[:-1][size > 1].tolist(), size[size > 1].tolist()):
            yield [c[a : a + n] for c in cols]
        held = [c[cuts[-1] :] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield held


def _emit(u: list, v: list) -> pa.RecordBatch:
    a, b = np.concatenate(u), np.concatenate(v)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    u, v, n = [], [], 0
    for a, b in found:
        u.append(a)
        v.append(b)
        n += len(a)
        if n > 1 << 18:
            yield _emit(u, v)
            u, v, n = [], [], 0
    if n:
        yield _emit(u, v)


def _met(limit: int, far: int):
    """Per anchor: pairs (u, v) that sketches let pass, of dense homes the nearest only; of large groups the rows as they are (place, u, sketch).

    Columns place (twice the anchor, plus 1 for a home), node, sketch; sorted by place.
    """
    names, kinds = ["place", "u", "v", "sketch", "dense"], [*[pa.int64()] * 4, pa.bool_()]

    def rows(cols: list) -> pa.RecordBatch:
        size = next(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def compare(g: np.ndarray, node: np.ndarray, sketch: np.ndarray, home: np.ndarray) -> Iterator[tuple]:
        first, last = np.searchsorted(g, g), np.searchsorted(g, g, side="right")
        homes = np.flatnonzero(home)
        count = (last - first)[homes]
        done = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(homes):
            b = max(a + 1, int(np.searchsorted(done, done[a] + (1 << 20), side="right")) - 1)
            x = np.repeat(homes[a:b], count[a:b])
            y = np.arange(len(x)) - np.repeat(done[a:b] - done[a], count[a:b]) + first[x]
            near = (np.bitwise_count(sketch[x] ^ sketch[y]) <= far) & (node[x] != node[y])
            if near.any():
                yield x[near], y[near]
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1] >> 1 << 1))  # the last group may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield from whole([c[:cut] for c in cols])
        if held is not None:
            yield from whole(held)
        K.release()

    def whole(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        place, node, sketch = cols
        anchor, home = place >> 1, (place & 1).astype(bool)
        size = np.searchsorted(anchor, anchor, side="right") - np.searchsorted(anchor, anchor)
        small, crowd = np.flatnonzero(size <= limit), size > limit
        all_, nearest = [], []
        for x, y in compare(anchor[small], node[small], sketch[small].view(np.uint64), home[small]):
            x, y = small[x], small[y]
            many = np.bincount(x, minlength=len(node))[x] > FEW
            all_.append((x[~many], y[~many]))
            x, y = x[many], y[many]
            if len(x):
                order = np.lexsort((np.bitwise_count(sketch[x].view(np.uint64) ^ sketch[y].view(np.uint64)), x))
                first = order[np.concatenate([[True], np.diff(x[order]) > 0])]
                nearest.append((x[first], y[first]))
        for found, dense in ((all_, False), (nearest, True)):
            if found and sum(len(x) for x, _ in found):
                u, v = (node[np.concatenate(c)] for c in zip(*found))
                pairs = _emit([u], [v])
                yield rows([None, pairs.column(0), pairs.column(1), None, np.full(pairs.num_rows, dense)])
        if crowd.any():
            yield rows([place[crowd], node[crowd], None, sketch[crowd], np.ones(crowd.sum(), bool)])

    return run


def _sizes_allow(n: np.ndarray, x, y, share: tuple[int, int]) -> np.ndarray:
    p, q = share
    return q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y])


def _nearest(far: int):
    """Each home's nearest partner by sketch, if that may be near enough. Columns anchor, i, j, node, sketch, home, c; sorted by the first three."""

    def pairs(batches):
        for _, i, j, node, sketch, home, c in _groups(batches, 3):
            across, sketch = i[0] != j[0], sketch.view(np.uint64)
            homes = np.flatnonzero(home)
            for a in range(0, len(homes), 256):
                x = homes[a : a + 256, None]
                away = np.bitwise_count(sketch[x] ^ sketch).astype(np.int16)
                away[(node[x] == node) | (across & (c[x] == c))] = SKETCH + 1
                y = away.argmin(axis=1)
                near = away[np.arange(len(x)), y] <= far
                if near.any():
                    yield node[x[near, 0]], node[y[near]]

    return lambda batches: _gathered(pairs(batches))


def _touching(sketch: np.ndarray, homes: np.ndarray, comp: np.ndarray, c: np.ndarray | None, far: int) -> np.ndarray:
    """Which rows of a group sketches may link to another component (and, given chunks c, to another chunk)."""
    hit = np.zeros(len(sketch), bool)
    for a in range(0, len(homes), 256):
        x = homes[a : a + 256, None]
        near = (np.bitwise_count(sketch[x] ^ sketch) <= far) & (comp[x] != comp)
        if c is not None:
            near &= c[x] != c
        hit |= near.any(axis=0)
        hit[x[near.any(axis=1), 0]] = True
    return hit


def _across(share: tuple[int, int], far: int):
    """Pairs of different components that sketches and bitmaps let pass, the larger set a home.

    Columns anchor, i, j, node, sketch, n, home, c (the chunk), component, bitmap; sorted by the first three.
    """
    p, q = share

    def pairs(batches):
        for _, i, j, node, sketch, n, home, c, comp, bitmap in _groups(batches, 3):
            sketch = sketch.view(np.uint64)
            hit = _touching(sketch, np.flatnonzero(home), comp, c if i[0] != j[0] else None, far)
            if not hit.any():
                continue
            i, j, node, sketch, n, home, c, comp, bitmap = (k[hit] for k in (i, j, node, sketch, n, home, c, comp, bitmap))
            order = np.lexsort((node, n))
            sketch = sketch[order]
            node, home, c, comp, bitmap = node[order], home[order], c[order], comp[order], bitmap[order]
            n = n[order].astype(np.int64)
            size = np.fromiter(map(len, bitmap), np.int64, len(bitmap))
            across = i[0] != j[0]
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                twice = np.flatnonzero(size == 2 * width)
                maps = np.frombuffer(b"".join(bitmap[own]), np.uint64).reshape(len(own), -1)
                if len(twice):
                    folded = np.frombuffer(b"".join(bitmap[twice]), np.uint64).reshape(len(twice), 2, -1)
                    maps = np.concatenate([maps, folded[:, 0] ^ folded[:, 1]])
                at = np.concatenate([own, twice])  # ascending in n: sizes follow n
                for k in range(len(own)):
                    x = own[k]
                    last = np.searchsorted(n[at], q * n[x] // p, side="right")
                    y = at[k + 1 : last]
                    want = (comp[y] != comp[x]) & home[y] & _sizes_allow(n, x, y, share)
                    want &= np.bitwise_count(sketch[y] ^ sketch[x]) <= far
                    if across:
                        want &= c[y] != c[x]
                    rows = np.flatnonzero(want)
                    if not len(rows):
                        continue
                    differ = np.bitwise_count(maps[k + 1 + rows] ^ maps[k]).sum(axis=1, dtype=np.int64)
                    y = y[rows]
                    y = y[(p + q) * differ <= (q - p) * (n[x] + n[y])]
                    if len(y):
                        yield np.full(len(y), node[x]), node[y]

    return lambda batches: _gathered(pairs(batches))


def _passing(share: tuple[int, int]):
    """The pairs (u, v, x, y, a, b: sizes and bitmaps) that bitmaps let pass."""
    p, q = share

    def fold(bitmap: np.ndarray, width: int) -> np.ndarray:
        return np.bitwise_xor.reduce(bitmap.reshape(-1, width), axis=0)

    def passes(x: int, y: int, a: bytes, b: bytes) -> bool:
        if q * min(x, y) < p * max(x, y):
            return False
        one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        width = min(len(one), len(two))
        return (p + q) * int(np.bitwise_count(fold(one, width) ^ fold(two, width)).sum()) <= (q - p) * (x + y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [passes(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _members(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [shingles(x.as_py(), shingle).view(np.int64) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"])
        K.release()

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, share: tuple[int, int], tasks: int) -> DataFrame:
    """The pairs (u, v) of similarity `share` at least, by bitmaps and then by the sets; written.

    nodes: (node, size, bitmap, _id, _th: a row that holds the set); docs: (_id, _th, text).
    """
    p, q = share
    one = nodes.select(F.col("node").alias("u"), F.col("size").alias("x"), F.col("bitmap").alias("a"))
    two = nodes.select(F.col("node").alias("v"), F.col("size").alias("y"), F.col("bitmap").alias("b"))
    pairs = pairs.distinct().join(one, "u").join(two, "v").select("u", "v", "x", "y", "a", "b")
    pairs = materialize(pairs.mapInArrow(_passing(share), "u long, v long"), "copies-pairs", most=tasks)
    named = nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select("node", "_id", "_th")
    named = materialize(named, "copies-named", most=tasks)  # mostly few: the planner then broadcasts them rather than shuffle texts
    texts = docs.join(named, ["_id", "_th"]).select("node", "text")
    sets = materialize(texts.mapInArrow(_members(shingle), "node long, members array<long>"), "copies-sets").dropDuplicates(["node"])
    left = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    rows = pairs.join(left, "u").join(right, "v")
    return materialize(rows.where((p + q) * both >= p * (F.size("a") + F.size("b"))).select("u", "v"), "copies-links", most=tasks)


def anchored(nodes: DataFrame, bits: int, blocks: int, *more: str) -> DataFrame:
    """(place, node, sketch, *more): each set at every anchor within 2 of each of its blocks; place: see `_met`."""
    rows = nodes.select("node", "sketch", *more, F.posexplode("blocks").alias("k", "block"))
    rows = rows.select("*", F.explode(near_anchors(F.col("block"), bits, 2)).alias("near"))
    anchor = F.col("block").bitwiseXOR(F.col("near.mask")).bitwiseOR(F.shiftleft(F.col("k").cast("long"), 40))
    return rows.select((anchor * 2 + F.col("near.home").cast("long")).alias("place"), "node", "sketch", *more)


def similar_texts(
    docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE, recall: float = RECALL, limit: int = LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """(_id, _th, component) of `docs` (_id, _th, text; _id and _th name a row): rows that links connect share a component."""
    docs = docs.select("_id", "_th", "text")
    tasks = spread(docs)
    bits, blocks = plan(docs.count(), share, recall)
    schema = "_id long, _th long, node long, size int, sketch long, blocks array<long>, bitmap binary"
    prints = materialize(docs.mapInArrow(_prints(shingle, bits, blocks), schema), "copies-prints")
    nodes = materialize(prints.where("size IS NOT NULL").dropDuplicates(["node"]), "copies-nodes", most=tasks)
    posts = anchored(nodes, bits, blocks).repartition(tasks, F.shiftright("place", 1)).sortWithinPartitions("place")
    met = "place long, u long, v long, sketch long, dense boolean"
    met = materialize(posts.mapInArrow(_met(limit, sketch_limit(share)), met), "copies-met")
    anchor, home = F.shiftright("place", 1).alias("anchor"), F.expr("place % 2 = 1").alias("home")

    def chunked(r: DataFrame, *columns: str) -> DataFrame:
        """Groups anchor, i, j: all rows of an anchor of up to `chunk` rows, else pairs of chunks of it."""
        s = F.ceil(F.count(F.lit(1)).over(W.partitionBy("anchor")) / chunk).cast("int")
        r = r.withColumn("s", s).withColumn("c", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
        one = r.where("s = 1").select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), *columns)
        r = r.where("s > 1").withColumn("d", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        r = one.unionByName(r.select("anchor", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), *columns))
        return r.repartition(tasks, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    large = met.where("place IS NOT NULL").select(anchor, home, F.col("u").alias("node"), "sketch")
    nearest = chunked(large, "node", "sketch", "home", "c").mapInArrow(_nearest(sketch_limit(share)), "u long, v long")
    pairs = met.where("place IS NULL").select("u", "v").unionByName(nearest)
    links = _confirmed(pairs, nodes, docs, shingle, share, tasks)
    found = materialize(components(links, tasks), "copies-found", most=tasks)

    dense = met.where("dense").select(F.explode(F.array("u", "v")).alias("node")).where("node IS NOT NULL").distinct()
    dense = nodes.join(dense, "node", "left_semi").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    carried = "comp", "n", "bitmap"
    dense = materialize(dense.select("node", "sketch", "blocks", "comp", F.col("size").alias("n"), "bitmap"), "copies-dense", most=tasks)
    if dense.limit(1).count():
        rows = anchored(dense, bits, blocks, *carried).select(anchor, home, "node", "sketch", *carried)
        rows = chunked(rows, "node", "sketch", "n", "home", "c", "comp", "bitmap")
        more = rows.mapInArrow(_across(share, sketch_limit(share)), "u long, v long")
        more = _confirmed(more, nodes, docs, shingle, share, tasks)
        if more.limit(1).count():
            found = materialize(components(links.unionByName(more), tasks), "copies-found", most=tasks)
    return prints.select("_id", "_th", "node").join(found, "node", "left").select("_id", "_th", F.coalesce("component", "node").alias("component"))
