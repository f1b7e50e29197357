"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio.

Each document gets surface counts (words, symbols, repeated lines, repeated 8-word windows) and the
mean, over its character trigrams, of log(p_trusted / p_raw): two multinomials over hashed trigrams,
one of a trusted target, one of the whole raw corpus. The mean is compared with one fixed threshold,
so a document's verdict depends on no other document's rank.

Bounds. The raw multinomial counts every document. The trusted one counts at most `TRUSTED_SAMPLE`
labelled documents (quality 1, not toxic), those with the smallest md5 of their id. A model is
`BUCKETS` numbers, whatever the corpus. Counts are summed per partition before they are shuffled.

Exactness. Repeated windows are found by numbers of words and windows, not by hashes.

Edge cases. A null or empty text has no words, so it is base_failed. A text under three code points
has ratio 0. Without trusted documents both multinomials are smoothed alike and the ratio only
measures how common the trigrams are; verdicts are still defined. Repeated rows get equal results.
Result columns replace input columns of the same name. An empty table has an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import BLANKS, table

BUCKETS = 16381
TRUSTED_SAMPLE = 20_000
THRESHOLD = -0.3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("llr", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CODE_UNITS = 1 << 20


def trigram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's code-point trigrams (A-Z lower-cased), in slices of bounded size."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for a in range(0, max(len(points) - 2, 0), _CODE_UNITS):
        x = points[a : a + _CODE_UNITS + 2].astype(np.uint64)
        x += np.uint64(32) * ((x >= 65) & (x <= 90))
        yield ((x[:-2] * np.uint64(1000003) + x[1:-1] * np.uint64(10007) + x[2:]) % np.uint64(BUCKETS)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, trusted) counts from (text, trusted boolean): one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("trusted").to_pylist()):
                for b in trigram_buckets(text.as_py() or ""):
                    n = np.bincount(b, minlength=BUCKETS)
                    raw += n
                    if good:
                        trusted += n
            K.release()
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(trusted[seen])], ["bucket", "raw", "trusted"]
        )

    parts = docs.select("text", "trusted").mapInArrow(count, "bucket int, raw long, trusted long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_SAMPLE) -> DataFrame:
    """At most `bound` ids of documents labelled good and not toxic, by the smallest md5 of the id."""
    one = labels.where("doc_id is not null").groupBy("doc_id")
    good = one.agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    return good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound).select("doc_id")


def fit_log_ratio(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED_SAMPLE) -> np.ndarray:
    """log(p_trusted / p_raw) per bucket, both add-one smoothed. `BUCKETS` rows reach the driver."""
    ids = trusted_ids(labels, bound).withColumn("trusted", F.lit(True))
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")  # `bound` ids at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in ngram_counts(flagged).toLocalIterator():
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _pairs_numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b), equal for equal pairs; a and b are numbers below 2^32."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]


def repeated_words(word: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For words (number, text index, in order): is the word in a window found twice or more in its text?

    Windows are numbered by doubling: pairs of words, of pairs, of those; so equal numbers are equal windows.
    """
    n = len(word)
    covered = np.zeros(n, bool)
    if n < WINDOW:
        return covered
    w, length = word, 1
    while length < WINDOW:
        w, length = _pairs_numbered(w[:-length], w[length:]), 2 * length
    whole = np.flatnonzero(text_of[: n - WINDOW + 1] == text_of[WINDOW - 1 :])
    key = _pairs_numbered(w[whole], text_of[whole])
    twice = np.bincount(key)[key] > 1 if len(key) else np.zeros(0, bool)
    edges = np.zeros(n + 1, np.int64)
    at = whole[twice]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return np.cumsum(edges)[:n] > 0


def _numbered(raw: list[bytes]) -> np.ndarray:
    """The words of all texts as numbers, equal for equal words."""
    numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
    parts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for text in raw for words in K.words_of(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _surface(raw: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words of the texts."""
    buf, a, b = K.joined(raw)
    starts, ends = K.word_spans(buf)
    first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
    text_of = np.searchsorted(b, starts)
    points = ((buf & 0xC0) != 0x80) & ~K.IS_BLANK[buf]
    repeated = repeated_words(_numbered(raw), text_of)
    return [last - first, K.per_text(points, a, b), K.per_text(_IS_SYMBOL[buf], a, b), K.per_text(repeated, first, last)]


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, log_ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` (with a text column) plus the counts, base_failed, llr and kept."""
    names = [f.name for f in _RESULT]
    keep = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(log_ratio, np.float64))  # `BUCKETS` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for a, b in K.slices(batch.column("text")):
                yield judged(batch.slice(a, b - a), ratio)
            K.release()

    def judged(part: pa.RecordBatch, ratio: np.ndarray) -> pa.RecordBatch:
        texts = [x or "" for x in part.column("text").to_pylist()]
        n_words, chars, symbols, repeats = _surface([x.encode("utf-8", "surrogatepass") for x in texts])
        dups = np.fromiter(map(dup_lines, texts), np.int64, len(texts))
        llr = np.zeros(len(texts))
        for i, text in enumerate(texts):
            total = sum(float(ratio[b].sum()) for b in trigram_buckets(text))
            llr[i] = total / (len(text) - 2) if len(text) > 2 else 0.0
        failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
        new = [n_words, chars, symbols, dups, repeats, failed, llr, ~failed & (llr >= threshold)]
        return pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(x) for x in new], keep + names)

    schema = T.StructType([docs.schema[c] for c in keep] + list(_RESULT))
    return docs.select(*keep).mapInArrow(run, schema)


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit_log_ratio(docs, table(spark, sf_dir, "labels")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, u.word, u.i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d) x,
      unnest(ws) WITH ORDINALITY AS u(word, i)),
win AS (SELECT r, i, CASE WHEN count(*) OVER g = 8 THEN string_agg(word, ' ') OVER g END AS g
        FROM w WINDOW g AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AND g IS NOT NULL AS t FROM win),
cov AS (SELECT r, bool_or(t) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice),
rep AS (SELECT r, count(*) FILTER (c) AS n FROM cov GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(word)) AS c FROM w GROUP BY r),
base AS (
  SELECT d.r, d.doc_id, coalesce(wc.n, 0)::BIGINT AS n_words, coalesce(wc.c, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN wc USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r)),
ch AS (SELECT d.r, d.doc_id, u.i, CASE WHEN u.c BETWEEN 65 AND 90 THEN u.c + 32 ELSE u.c END AS c
       FROM (SELECT r, doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) AS cs FROM d WHERE text <> '') d,
       unnest(cs) WITH ORDINALITY AS u(c, i)),
tri AS (SELECT r, doc_id, (c * 1000003 + lead(c) OVER q * 10007 + lead(c, 2) OVER q) % 16381 AS b
        FROM ch WINDOW q AS (PARTITION BY r ORDER BY i)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
         HAVING min(quality) = 1 AND max(coalesce(toxic, 0)) = 0 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20000),
cnt AS (SELECT b, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM good)) AS good FROM tri WHERE b IS NOT NULL GROUP BY b),
tot AS (SELECT sum(raw) AS raw, sum(good) AS good FROM cnt),
lr AS (SELECT b, ln((cnt.good + 1) / (tot.good + 16381)::DOUBLE) - ln((cnt.raw + 1) / (tot.raw + 16381)::DOUBLE) AS v FROM cnt, tot),
sc AS (SELECT r, avg(v) AS llr FROM tri JOIN lr USING (b) GROUP BY r),
f AS (SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(llr, 0) >= -0.3 AS kept
FROM f LEFT JOIN sc USING (r)
"""
