import random

import corpus_pipeline
import pytest
from regionloom.llm import similar as N


def plain_keepers(rows):
    """The smallest id of each component of 5-word Jaccard >= 0.8, by all pairs."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return set(low.values())


def planted(seed):
    """Texts of 4 to 120 words with edits of every size, a shared passage, and copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [word() for _ in range(25)], ["", None, " \n", "a b"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(4, 120))]
        texts.append(" ".join(base))
        for _ in range(8):
            new = base.copy()
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limit,chunk", [(N.LIMIT, N.CHUNK), (2, 7), (50, 7)])
def test_stage_keeps_what_all_pairs_keep(spark, monkeypatch, limit, chunk):
    plain = N.similar_texts
    monkeypatch.setattr(N, "similar_texts", lambda docs: plain(docs, limit=limit, chunk=chunk))
    rows = planted(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_keepers(rows)


def test_recall_by_similarity(spark):
    """Pairs of texts alone in their group: each link is found by the fingerprints or not at all."""
    rng, rows, bands = random.Random(11), [], {}
    for k in range(600):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(60, 300))]
        new = base.copy()
        for _ in range(rng.randint(1, max(1, len(base) // 45))):
            new[rng.randrange(len(new))] = f"x{k}"
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, new)]
        share = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(new))]
        bands.setdefault("below" if share < 0.8 else "0.8" if share < 0.9 else "0.9", []).append(2 * k + 1)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    recall = {b: sum(i not in kept for i in ids) / len(ids) for b, ids in bands.items()}
    assert len(bands) == 3 and recall["below"] == 0 and recall["0.8"] >= 0.98 and recall["0.9"] == 1
    assert {2 * k for k in range(600)} <= kept


def test_plan_brings_its_recall():
    for n in (10, 10**4, 10**6, 10**9):
        bits, blocks = N.plan(n)
        d = N.differing()
        meet = (1 - d) ** bits + bits * d * (1 - d) ** (bits - 1)
        assert 1 - (1 - meet) ** blocks >= N.RECALL and 15 <= bits <= 30


def test_null_ids_keep_one_row_a_component_and_join_no_others(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(None, " ".join(a)), (None, near(a)), (None, " ".join(b)), (1, near(b)), (2, "another text")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    assert ids == [1, 2, None]


def test_equal_id_and_text_of_other_rows(spark):
    """Rows (1, A), (5, A), (5, B): the copy (5, A) goes although id 5 stays with another text."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "q"), (5, b, "k")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(map(tuple, got)) == [(1, a, "x"), (5, b, "k")]
