import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from regionloom.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    rows = L.op7_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]
    assert np.mean(right) > 0.98
    assert abs(np.mean([r["score"] for r in held]) - np.mean(right)) < 0.05  # calibrated
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_features_do_not_depend_on_slices(monkeypatch):
    text = "Voilà, un été! 12 -- ÇA va?  " * 40
    whole = L.features(text)
    monkeypatch.setattr(L, "_POINTS", 17)
    assert all(map(np.array_equal, whole, L.features(text))) and whole[1].sum() > 0


def test_edge_cases(spark):
    rows = [(i, t, l) for i in range(30) for t, l in (("the cat and the dog", "en"),)] + [(100 + i, "der hund und die katze", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !?", "de"), (203, "und die katze", None), (None, "the dog", "en"), (204, "the dog " * 30000, "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = L.fit(df.where(~L.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in L.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[200]["score"] == 0.0
    assert got[203]["lang_pred"] == "de" and got[None]["lang_pred"] == "en" and got[204]["lang_pred"] == "en"
    none = L.fit(df.limit(0))
    assert {r["lang_pred"] for r in L.predict(df, none).collect()} == {"und"}


def plain_model(rows):
    """FTRL on dictionaries: (id, text, lang) to {feature: weights by language} and the languages."""
    seen = [(i, L.features(t), y) for i, t, y in rows]
    df = Counter(int(b) for _, (at, _), _ in seen for b in at)
    idf = {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in df.items()}
    langs = sorted({y for *_, y in rows})
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= L.L1:
            return 0.0
        return (math.copysign(L.L1, z[k]) - z[k]) / ((L.BETA + math.sqrt(n[k])) / L.ALPHA + L.L2)

    for _ in range(L.EPOCHS):
        for k, (_, (at, counts), y) in enumerate(seen):
            if k % L.CALIBRATION == 0:
                continue
            x = {int(b): math.log1p(c) * idf[int(b)] for b, c in zip(at, counts)}
            size = math.sqrt(sum(v * v for v in x.values()))
            w = {(b, c): weight((b, c)) for b in x for c in range(len(langs))}
            logits = [sum(v / size * w[b, c] for b, v in x.items()) for c in range(len(langs))]
            e = [math.exp(v - max(logits)) for v in logits]
            for b, v in x.items():
                for c in range(len(langs)):
                    g = v / size * (e[c] / sum(e) - (langs[c] == y))
                    sigma = (math.sqrt(n[b, c] + g * g) - math.sqrt(n[b, c])) / L.ALPHA
                    z[b, c] += g - sigma * w[b, c]
                    n[b, c] += g * g
    return langs, {k: weight(k) for k in list(z) if weight(k)}


def test_weights_against_plain_ftrl(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("the dog", "en"), ("der hund", "de"), ("a cat and", "en"), ("und ein", "de"), ("of it", "en"), ("es ist", "de"), ("we", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = {r["id"]: r["h"] for r in L.sample(df).collect()}
    langs, want = plain_model(sorted(rows, key=lambda r: order[str(r[0])]))
    model = L.fit(df)
    assert model["langs"] == langs
    got = {(int(b), int(c)): model["w"][b, c] for b, c in zip(*np.nonzero(model["w"]))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [("7", "the same text", "en")] * 300 + [(f"k{i}", f"text number {i}", "en") for i in range(3000)] + [("7", "another text", "en")] * 5
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    ids = L.sample(df, 50).collect()
    assert len(ids) == 50 and len({(r["id"], r["th"]) for r in ids}) == 50
    assert L.sample(df, 5000).count() == 3002
    assert L.predict(df.limit(5), L.fit(df, 50)).where("lang_pred = 'en'").count() == 5
