import random
import re

import numpy as np
import pytest
from regionloom.llm import simhash as S
from xxhash import xxh64_intdigest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def plain_fingerprint(text, k=4):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, threshold=4):
    ids = [i for i, _ in rows]
    fps = np.array([f for _, f in rows], np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold):
            root[find(int(j))] = find(i)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return {i: low[find(k)] for k, i in enumerate(ids)}


def test_documents_against_brute_force(spark):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in S.op6_simhash_near_dedup(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
    want = plain_components(fps)
    assert got == {i: (f, want[i]) for i, f in fps}


@pytest.mark.parametrize("limit,blocks", [(4096, 3), (7, 3), (4096, 2), (7, 4)])
def test_planted_fingerprints(spark, limit, blocks):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(8):  # chains of close fingerprints
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << b) for b in range(64)}
    rows = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in rows], "fp long, node long")
    from regionloom.llm.components import components

    got = {i: i for i, _ in rows} | {r["node"]: r["component"] for r in components(S.links(nodes, 4, S.split(64, blocks), limit)).collect()}
    assert got == plain_components(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (None, "c d e f g"), (7, "c d e f g"), (7, "c d e f g"), (8, "x " * 50000)]
    df = spark.createDataFrame([(i, t, "t") for i, t in rows], DOCS + ", fp string")
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in S.near_duplicates(df).collect()), key=str)
    by = {}
    for i, f, c in got:
        by.setdefault(i, (f, c))
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[4] == by[5] and by[4][1] == 4
    assert by[None][1] == 7 and by[7][1] == 7 and len(got) == 9
    assert S.near_duplicates(df.where("doc_id < 0")).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "f g h i j"), (3, "f g h i j"), (4, "k l m n o")], DOCS)
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in S.near_duplicates(nulls).collect() if r["doc_id"] or r["component_id"]) == [(0, 3), (3, 3), (4, 4)]
    only_null = spark.createDataFrame([(None, "p q r s")], DOCS)
    assert S.near_duplicates(only_null).first()["component_id"] is None


def test_blocks_follow_the_number_of_fingerprints():
    sizes = [len(S.covering(n)) for n in (10, 10**5, 10**7, 10**9, 10**11)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 2
    assert all(sum(n for _, n in S.covering(n)) == 64 for n in (10, 10**9))
