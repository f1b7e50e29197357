"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of a text's letters (lower case, every run of other characters one
blank), hashed to `FEATURES` buckets, weighted log(1 + count) * idf and scaled to unit length. The
weights are learned by follow-the-regularised-leader with an elastic net (L1 and L2), so most of
them stay zero. A temperature, fitted on examples the weights did not see, calibrates the scores.

Bounds. The idf counts every training document. The weights are fitted on at most `PER_LANGUAGE`
distinct training documents (id, language and text) of each language, those with the smallest hash of id
and text, in one task that holds their features; a model is FEATURES x languages numbers, broadcast.
Prediction sees only the text.

Edge cases. Ids may be of any type that has a text form. Null texts and texts without a letter are 'und' with score 0. Documents with a null id
are never learned from; null languages neither. With nothing to learn from all is 'und'. Repeated
rows get equal results. Result columns replace input columns of the same name. An empty table has an empty
result. A very long text counts whole, as one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

FEATURES = 1 << 14
PER_LANGUAGE = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.5, 1.0, 0.02, 1e-4
CALIBRATION = 5  # every fifth example calibrates instead of training
UNKNOWN = "und"
_POINTS = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(FEATURES, np.int64)
    whole = _letters()[points]
    blank = whole == 32
    whole = whole[~(blank & np.concatenate([[False], blank[:-1]]))]
    for a in range(0, len(whole), _POINTS):
        b = a + _POINTS
        c = whole[a : b + 2]
        with np.errstate(over="ignore"):
            h = c * np.uint32(0x9E3779B1)
            counts += _bucketed(h[: b - a][c[: b - a] != 32])
            h2 = h[:-1] * np.uint32(31) + c[1:] * np.uint32(0x85EBCA6B)
            counts += _bucketed(h2[: b - a] ^ np.uint32(0x55555555))
            h3 = h2[:-1] * np.uint32(37) + c[2:] * np.uint32(0xC2B2AE35)
            counts += _bucketed(h3[: b - a] ^ np.uint32(0xAAAAAAAA))
    at = np.flatnonzero(counts)
    return at, counts[at]


def _bucketed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(18), minlength=FEATURES)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(bucket, df, n): in how many of the n texts each bucket occurs. One row per bucket and one for n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for x in batch.column("text"):
                at, _ = features(x.as_py() or "")
                df[at] += 1
                df[FEATURES] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "df"])

    return docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[at]
    size = np.sqrt((x * x).sum())
    return x / size if size else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates, for a softmax."""

    def __init__(self, classes: int):
        self.z = np.zeros((FEATURES, classes))
        self.n = np.zeros((FEATURES, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = softmax(x @ w)
        g[y] -= 1.0
        g = x[:, None] * g[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that minimises the log loss (golden section on its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, k = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - k * (b - a), a + k * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(id, lang, th, h): at most `per_language` distinct documents of a language, by the smallest hash of id and text.

    Only documents whose hash lies so low that about 1.3 times as many remain are ranked, so no language
    is sorted as a whole.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "lang", F.xxhash64("text").alias("th")).distinct()
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "th"), 11))  # 53 bits
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    low = F.col("h").cast("double") * F.col("n") <= F.lit(1.3 * per_language + 20) * F.lit(float(1 << 53))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "id", "th"))
    return rows.join(sizes, "lang").where(low).withColumn("r", rank).where(F.col("r") <= per_language).select("id", "lang", "th", "h")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """A model from (doc_id, text, lang), which must hold only what may be learned from."""
    docs = docs.where("lang is not null and text is not null")
    idf = np.zeros(FEATURES)
    total = 0
    for r in document_frequency(docs).toLocalIterator():  # FEATURES + 1 rows at most
        if r["bucket"] == FEATURES:
            total = r["df"]
        else:
            idf[r["bucket"]] = r["df"]
    idf = np.log((1 + total) / (1 + idf)) + 1.0
    key = ["id", "lang", "th"]
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "lang", F.xxhash64("text").alias("th"), "text")
    # the sample is bounded: per_language rows a language
    few = rows.join(F.broadcast(sample(docs, per_language)), key).dropDuplicates(key)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [features(x.as_py()) for x in b.column("text")]
            at = pa.array([p[0].astype(np.int32) for p in parts], pa.list_(pa.int32()))
            n = pa.array([p[1] for p in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("id"), b.column("lang"), at, n], ["h", "id", "lang", "at", "n"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("h", "id", "lang")), b.column("at"), b.column("n"))]
        if not rows:
            return
        rows.sort(key=lambda r: r[:3])
        langs = sorted({r[2] for r in rows})
        examples = [(np.asarray(r[3].values), np.asarray(r[4].values), langs.index(r[2])) for r in rows]
        examples = [(a, weighted(a, n, idf), y) for a, n, y in examples if len(a)]
        model = Ftrl(len(langs))
        kept = [e for i, e in enumerate(examples) if i % CALIBRATION]
        for _ in range(EPOCHS):
            for a, x, y in kept:
                model.learn(a, x, y)
        w = model.weights()
        held = [e for i, e in enumerate(examples) if not i % CALIBRATION]
        t = temperature(np.array([x @ w[a] for a, x, _ in held]).reshape(-1, len(langs)), np.array([y for *_, y in held], int))
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()], pa.int32()), pa.array([[t], *w[at].tolist()], pa.list_(pa.float64())), pa.array([langs] + [None] * len(at), pa.list_(pa.string()))],
            ["bucket", "w", "langs"],
        )

    rows = few.mapInArrow(featured, "h long, id string, lang string, at array<int>, n array<bigint>")
    fitted = rows.coalesce(1).mapInArrow(train, "bucket int, w array<double>, langs array<string>").collect()
    head = next((r for r in fitted if r["bucket"] == -1), None)
    langs = head["langs"] if head else []
    w = np.zeros((FEATURES, max(1, len(langs))))
    for r in fitted:
        if r["bucket"] >= 0:
            w[r["bucket"]] = r["w"]
    return {"langs": langs, "w": w, "idf": idf, "t": head["w"][0] if head else 1.0}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` (with a text column) plus lang_pred and score."""
    names = ["lang_pred", "score"]
    keep = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers a language, and as many more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w, idf, t = (shared.value[k] for k in ("langs", "w", "idf", "t"))
        for batch in batches:
            best, score = [], []
            for x in batch.column("text"):
                text = x.as_py()
                if not langs or not has_letter(text):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, n = features(text)
                p = softmax(weighted(at, n, idf) @ w[at] / t)
                k = int(p.argmax())
                best.append(langs[k])
                score.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Is a document's fold held out? Null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
