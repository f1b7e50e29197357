import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from regionloom.llm import lm

SF = "/root/testdata/sf0.001"


def toks(t):
    t = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def plain_scores(rows):
    """(learn, text) -> (n_tokens, n_known, N, base, score) by dictionaries."""
    n = [Counter() for _ in range(4)]
    begun = 0
    for learn, text in rows:
        if learn:
            begun += 1
            t = ["<s>", *toks(text)]
            for i in range(1, len(t)):
                for k in (1, 2, 3):
                    if i - k >= -1 and i + 1 - k >= 0:
                        n[k][tuple(t[i + 1 - k : i + 1])] += 1
    n[1].pop(("<s>",), None)
    total, v = sum(n[1].values()), len(n[1])
    out = []
    for _, text in rows:
        t = ["<s>", *toks(text)]
        score = base = known = 0
        for i in range(1, len(t)):
            c = n[1][(t[i],)]
            known += c > 0
            base += math.log10((c + 1) / (total + v + 1))
            p = ((c - lm.DISCOUNT) if c else lm.DISCOUNT * v) / total if total else 1.0
            h = begun if i == 1 else n[1][(t[i - 1],)]
            p = (n[2][t[i - 1], t[i]] + lm.MU * p) / (h + lm.MU)
            if i > 1:
                p = (n[3][t[i - 2], t[i - 1], t[i]] + lm.MU3 * p) / (n[2][t[i - 2], t[i - 1]] + lm.MU3)
            score += math.log10(p)
        out.append((len(t) - 1, known, total, base, score))
    return out


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2, d["text"]) for d in docs]
    want = {d["doc_id"]: x for d, x in zip(docs, plain_scores(rows))}
    got = lm.op3_lm_scoring(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(score, abs=1e-6)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edge_cases_and_many_blocks(spark):
    rows = [(1, True, None), (2, True, ""), (3, False, "The cat"), (4, True, "the CAT sat"), (4, True, "the CAT sat"), (None, None, "x y"), (6, True, "é " * 30000)]
    rows += [(7, True, "the cat sat on the mat"), (8, False, "the cat sat on the cat")]
    df = spark.createDataFrame([(i, b, t, "s", 5) for i, b, t in rows], "doc_id long, learn boolean, text string, score string, row int")
    want = sorted(zip([str(i) for i, *_ in rows], plain_scores([(bool(b), t) for _, b, t in rows])))
    got = sorted((str(r["doc_id"]), tuple(r)[2:]) for r in lm.score(df, 1000, 3).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1] == pytest.approx(w[1], rel=1e-9)
    assert lm.score(df.limit(0)).count() == 0
    untaught = lm.score(df.withColumn("learn", df.learn & False)).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["row"] == 5 for r in untaught)


def test_reading_in_step_and_one_by_one_agree(monkeypatch):
    texts = [f"a b c d {'e ' * (i % 7)} a b c" for i in range(40)]
    grams = lm.Grams([t.encode() for t in texts])
    counts = grams.counts(np.arange(40) % 3 > 0)
    machine = lm.BackoffAutomaton(grams, *(x.astype(np.int64) for x in counts), int(counts[0].sum()), int((counts[0] > 0).sum()))
    want = [x[4] for x in plain_scores([(i % 3 > 0, t) for i, t in enumerate(texts)])]
    for few in (0, 16, 1000):
        monkeypatch.setattr(lm, "FEW", few)
        assert machine.read(grams.starts, grams.stops) == pytest.approx(want, rel=1e-12)


def test_states_and_failure_arcs():
    """A text learned as a whole leads through pair states; an unknown word leads back to the root by failure arcs."""
    grams = lm.Grams([b"x y z", b"x y new z"])
    counts = [c.astype(np.int64) for c in grams.counts(np.array([True, False]))]
    machine = lm.BackoffAutomaton(grams, *counts, int(counts[0].sum()), int((counts[0] > 0).sum()))
    assert (machine.source[machine.arcs[2, 1:4]] >= machine.first_pair).all()
    state = machine.target[machine.arcs[2, 5]]  # after "x y" of the second text
    assert state >= machine.first_pair and machine.source[machine.arcs[2, 6]] == -1
    word = machine.failure[state]
    assert 0 < word < machine.first_pair and machine.failure[word] == 0 and machine.target[machine.arcs[0, 6]] == 0


def test_messages_grow_with_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, True, f"w{i % 50} v{i % 70} u{i} z") for i in range(3000)], "doc_id long, learn boolean, text string")
    kept, keep = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda d, tag: (kept.append(keep(d, tag)), kept[-1])[1])
    one = sorted(map(tuple, lm.score(df).collect()))
    many = sorted(map(tuple, lm.score(df, 10, 8).collect()))
    assert all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-12) for a, b in zip(one, many))
    rows = [k.where("block >= 0") for k in kept]
    blocks = [r.select("block").distinct().count() for r in rows]
    assert blocks[1] > 2000 and all(r.count() <= 128 * n for r, n in zip(rows, blocks))


def test_words_that_agree_on_half_their_hash_are_told_apart(spark):
    """After one pair come two words with the same upper 32 bits of the mixed hash, in training once and thrice."""
    from xxhash import xxh64_intdigest

    words = [f"w{i}" for i in range(300_000)]
    h = lm.K.mix(np.array([xxh64_intdigest(w.encode()) for w in words], np.uint64))
    half, order = h >> np.uint64(32), np.argsort(h)
    k = int(np.flatnonzero(half[order][1:] == half[order][:-1])[0])
    a, b = words[order[k]], words[order[k + 1]]
    assert h[order[k]] != h[order[k + 1]]
    rows = [(True, f"u v {a}")] + [(True, f"u v {b}")] * 3 + [(False, f"u v {a}"), (False, f"u v {b}")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, learn boolean, text string")
    got = {r["i"]: r["score"] for r in lm.score(df).collect()}
    for i, want in enumerate(plain_scores(rows)):
        assert got[i] == pytest.approx(want[-1], abs=1e-9)
    assert abs(got[4] - got[5]) > 0.05


def test_keys_travel_in_planes():
    from regionloom.llm import blocks

    rng = np.random.default_rng(2)
    for n, high in ((0, 1), (1, 1 << 63), (5, 3), (7000, 1 << 57), (300, 1 << 8), (2, 1)):
        k = np.sort(rng.integers(0, high, n).astype(np.uint64))
        assert (blocks.expand_keys(blocks.squeeze_keys(k)) == k).all()
    top = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert (blocks.expand_keys(blocks.squeeze_keys(top)) == top).all()
