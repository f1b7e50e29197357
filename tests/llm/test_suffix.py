import hashlib
import random

import pytest
from regionloom.llm import suffix as S

SF = "/root/testdata/sf0.001"


def plain(rows):
    """[(id, text)] -> [(id, n_bytes, n_removed, n_spans, sha256)] by a dictionary of windows."""
    raw = [(i if i is not None else S._LAST, (t or "").encode()) for i, t in rows]
    low = {}
    for i, b in raw:
        for a in range(len(b) - 49):
            w = b[a : a + 50]
            low[w] = min(i, low.get(w, i))
    out = []
    for (i, b), (own, _) in zip(raw, rows):
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if low[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((own, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_documents_against_brute_force(spark):
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in S.op8_suffix_array_dedup(spark, SF).collect())
    assert got == sorted(plain(rows))
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [1000, 3])
def test_planted_passages_and_edge_cases(spark, hot):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((100 - i, " ".join(word() for _ in range(12)) + passage[a:b] + " ".join(word() for _ in range(12))))
    rows += [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (5, "y" * 5000), (6, "y" * 60), (7, "y" * 3000 + "z"), (8, passage), (8, passage), (9, passage)]
    rows += [(None, passage), (10, "ab" * 2000), (11, "ba" * 900), (12, passage * 20)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    out = S.dedup_substrings(df, True, 2000, hot).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=str)
    assert got == sorted(plain(rows), key=str)
    for r in out:
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"]
    assert S.dedup_substrings(df.limit(0)).count() == 0


def test_strings_of_equal_weak_hashes_stay_apart(spark):
    """Thue-Morse words and their complements agree under polynomial hashes modulo 2^64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rows = [(1, "x" * 30 + word), (2, "y" * 30 + other), (3, other[:500] + "z" + word[:500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1000, 1):
        got = sorted(tuple(r) for r in S.dedup_substrings(df, hot=hot).collect())
        assert got == sorted(plain(rows))


def test_large_families_and_many_blocks(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd ") for _ in range(400))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 80))) + passage[: rng.randint(0, 400)] + str(i)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(plain(rows))
    sent = []
    keep = S.materialize
    monkeypatch.setattr(S, "materialize", lambda d, tag: (lambda m: (sent.append((tag, m.count())), m)[1])(keep(d, tag)))
    for block_bytes in (400, 4000):
        assert sorted(tuple(r) for r in S.dedup_substrings(df, block_bytes=block_bytes, tables=8).collect()) == want
    n = S.text_bytes(df)
    assert n // 400 > 1000 and all(rows <= 128 * (n // size + 1) for (_, rows), size in zip(sent, (400, 400, 4000, 4000)))


def test_families_beyond_the_limit_agree():
    rng = random.Random(5)
    base = bytes(rng.choice(b"ab") for _ in range(120))
    spans = [base[: 50 + i] for i in range(20)] + [bytes([99 + i]) + base[:60] for i in range(20)]
    ids = rng.sample(range(100), len(spans))
    assert S._smallest_by_windows(spans, ids) == S.smallest_ids(spans, ids)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x" * 60, "a", 5, "k"), (2, "x" * 60, "b", 6, "l")], "doc_id long, text string, sha string, rep long, row string")
    got = sorted(tuple(r) for r in S.dedup_substrings(df).select("doc_id", "sha", "rep", "row", "n_removed").collect())
    assert got == [(1, "a", 5, "k", 0), (2, "b", 6, "l", 60)]
