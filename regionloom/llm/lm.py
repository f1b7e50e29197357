"""LM scoring with a weighted backoff automaton.

The model is a trigram model with smoothed probabilities. The n-grams of the training texts are its
states: the empty one (the root), words (and the beginning of a text), and pairs of words. A state has
an arc for every word that followed it in training, and a failure arc to the state of its longest proper
suffix. With c the training counts, N tokens and V distinct ones:

    root      P(w)     = (c(w) - D) / N, for words not in training together D V / N
    word      P(w | v)  = (c(vw) + M P(w)) / (c(v) + M),         failure arc M / (c(v) + M)
    pair      P(w | uv) = (c(uvw) + M3 P(w | v)) / (c(uv) + M3), failure arc M3 / (c(uv) + M3)

Arcs carry log10 of these. A text is read once from left to right: the state carried so far takes its arc
for the next token or, as long as it has none, its failure arc; the weights on the way add up to the
score. An arc leads to the longest state that ends the text read: from a pair or a word to a pair, from
the root to the word, for a word not in training back to the root.

Scale. The model is never gathered anywhere: its n-grams grow with the corpus. A block of texts asks
for the counts of just its own n-grams, builds its part of the automaton from the answers and reads its
texts through it (see blocks.py). Counts are summed within blocks before they move. Within a block n-grams
are known by numbers, which are exact; between blocks by 64-bit hashes (XXH64, mixed), sent as sorted
differences: two of n words, pairs or triples fall together by a chance of n^2 / 2^65.

Edge cases. Null and empty texts are one end token. A null learn flag is false. With no training text
every probability is 1 (score 0). Repeated rows are learned and scored as often as they occur. An empty
table gives an empty result. Result columns replace input columns of the same name; other columns are
kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import kernels as K
from .blocks import LEAST_BUCKETS, TABLE_BUCKETS, block_count, bucket_count, bucket_edges, expand, expand_keys, squeeze, squeeze_keys, store_as_read, unpack
from .common import materialize, table, text_bytes
from .langid import held_out

DISCOUNT = 0.7
MU = 1000.0
MU3 = 3.0
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # of text whose n-grams a bucket can hold
FEW = 16  # texts that are read one by one rather than in step
_END, _BEGIN = 0, 1  # word numbers of every block
_RESERVED = (0x8BADF00D5EED0001, 0x8BADF00D5EED0002)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words to their numbers, given as they come."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = list(_RESERVED)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxh64_intdigest(word))
        return n


class Grams:
    """The tokens of texts, each text's words then its end, and their distinct n-grams.

    word, pair, triple: for every token the number of the word, of the pair and of the triple that it
    ends (-1 where a text has no triple yet); words, pairs: hashes by number; triples: the numbers of the
    first pair (which ascends) and of the last word.
    """

    def __init__(self, texts: list[bytes]):
        numbers, parts, stops, n = _Numbers(), [], [], 0
        end = np.array([_END], np.int32)
        for text in texts:
            for words in K.words_of(text, lower=True):
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                n += len(words)
            parts.append(end)
            n += 1
            stops.append(n)
        self.stops = np.array(stops, np.int64)
        self.starts = np.concatenate([[0], self.stops[:-1]]).astype(np.int64)
        self.word = np.concatenate(parts) if parts else np.zeros(0, np.int32)

        self.words = K.mix(np.array(numbers.hashes, np.uint64))
        h = self.words[self.word]
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.starts] = _BEGIN
        key = K.mix(self.words[before] * _STEP + h)
        self.pairs, first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.pair_words = before[first], self.word[first]
        longer = np.ones(len(h), bool)
        longer[self.starts] = False
        at = np.flatnonzero(longer)
        key = self.pair[at - 1].astype(np.uint64) << np.uint64(32) | self.word[at].astype(np.uint64)
        self.triples, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        self.triple = np.full(len(h), -1, np.int32)
        self.triple[at] = inverse
        self.triple_pairs = self.pair[at[first] - 1], self.pair[at[first]]

    def triple_keys(self) -> np.ndarray:
        """The triples' hashes by number."""
        return K.mix(self.pairs[self.triple_pairs[0]] * _STEP + self.words[self.triples.astype(np.uint32)])

    def counts(self, learn: np.ndarray) -> list[np.ndarray]:
        """How often each word, pair and triple stands in the texts to learn from."""
        on = np.repeat(learn, self.stops - self.starts)
        out = [np.bincount(x[on], minlength=len(names)) for x, names in ((self.word, self.words), (self.pair, self.pairs))]
        on &= self.triple >= 0
        return [x.astype(np.uint32) for x in (*out, np.bincount(self.triple[on], minlength=len(self.triples)))]


class BackoffAutomaton:
    """The automaton's part that a block needs: states and arcs for its own n-grams.

    words, pairs, triples: training counts by number; total and distinct: the training corpus's tokens
    and vocabulary. State 0 is the root, 1 + w a word's, 1 + words + p a pair's. An arc is known by its
    n-gram: words first, then pairs, then triples; `source` is -1 where training has no such n-gram.
    """

    def __init__(self, grams: Grams, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, total: int, distinct: int):
        w, self.first_pair = len(words), 1 + len(words)
        seen = words.astype(np.float64)
        root = np.where(words > 0, (seen - DISCOUNT) / max(total, 1), DISCOUNT * distinct / total if total else 1.0)
        if not total:
            root[:] = 1.0
        begun = seen.copy()
        begun[_BEGIN] = seen[_END]  # as often as a text ends, one begins
        a, b = grams.pair_words
        given_word = (pairs + MU * root[b]) / (begun[a] + MU)
        u, v = grams.triple_pairs
        given_pair = (triples + MU3 * given_word[v]) / (pairs[u] + MU3)
        self.weight = np.log10(np.concatenate([root, given_word, given_pair]))
        own = np.arange(len(pairs)) + self.first_pair
        self.source = np.concatenate([np.zeros(w, np.int64), np.where(pairs > 0, 1 + a, -1), np.where(triples > 0, own[u], -1)])
        self.target = np.concatenate([np.where(words > 0, 1 + np.arange(w), 0), own, own[v]])
        self.failure = np.concatenate([np.zeros(1 + w, np.int64), 1 + b])
        self.failure_weight = np.log10(np.concatenate([[1.0], MU / (begun + MU), MU3 / (pairs + MU3)]))
        self.arcs = np.stack([grams.word, w + grams.pair, np.where(grams.triple < 0, -1, w + len(pairs) + grams.triple)]).astype(np.int32)

    def read(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """log10 probabilities of the texts whose tokens are starts:stops."""
        order = np.argsort(starts - stops, kind="stable")  # long texts first
        at, left = starts[order].copy(), (stops - starts)[order]
        state = np.full(len(order), 1 + _BEGIN)
        score = np.zeros(len(order), np.longdouble)
        active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
        for j, n in enumerate(active.tolist()):  # the texts with a j-th token
            if n < FEW:
                for k in range(n):
                    score[k] += self._read_on(int(state[k]), int(at[k]) + j, int(at[k] + left[k]))
                break
            todo = np.arange(n)
            while len(todo):
                s, place = state[todo], at[todo] + j
                arc = self.arcs[(s > 0).astype(np.int8) + (s >= self.first_pair), place]
                taken = (self.source[arc] == s) & (arc >= 0)
                score[todo] += np.where(taken, self.weight[arc], self.failure_weight[s])
                state[todo] = np.where(taken, self.target[arc], self.failure[s])
                todo = todo[~taken]
        out = np.empty(len(order))
        out[order] = score
        return out

    def _read_on(self, state: int, start: int, stop: int) -> np.longdouble:
        """The rest of one text, from a state."""
        total = np.longdouble(0)
        for a in range(start, stop, 1 << 14):
            arcs = self.arcs[:, a : min(stop, a + (1 << 14))]
            source = np.where(arcs >= 0, self.source[arcs], -1).tolist()
            target, weight, sum_ = self.target[arcs].tolist(), self.weight[arcs].tolist(), []
            for i in range(arcs.shape[1]):
                k = 0 if not state else 1 if state < self.first_pair else 2
                while source[k][i] != state:
                    sum_.append(float(self.failure_weight[state]))
                    state = int(self.failure[state])
                    k -= 1
                sum_.append(weight[k][i])
                state = target[k][i]
            total += np.array(sum_, np.longdouble).sum()
        return total


def _block_rows(blobs: pa.Table) -> tuple[pa.Table, Grams, np.ndarray]:
    rows = unpack(blobs)
    texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in rows.column("text")]
    return rows.drop_columns(["text"]), Grams(texts), rows.column("learn").to_numpy(zero_copy_only=False).astype(bool)


_KINDS = ("words", "pairs", "triples")


_SENT = (*_KINDS, "n_words", "n_pairs", "n_triples")


def _ask(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in _SENT)])

    def ask(key, blobs):
        """Per bucket: sorted words, pairs and triples, and all counts."""
        _, grams, learn = _block_rows(blobs)
        keys, counts = [grams.words, grams.pairs, grams.triple_keys()], grams.counts(learn)
        del grams
        for i in (0, 2):  # pairs ascend
            order = np.argsort(keys[i])
            keys[i], counts[i] = keys[i][order], counts[i][order]
        edges = [bucket_edges(k, buckets) for k in keys]
        out = []
        for i in range(buckets):
            parts = [slice(e[i], e[i + 1]) for e in edges]
            if any(p.start < p.stop for p in parts):
                out.append((i, key[0].as_py(), *(squeeze_keys(k[p]) for k, p in zip(keys, parts)), *(squeeze(n[p]) for n, p in zip(counts, parts))))
        K.release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return ask


_ANSWER = "block long, bucket int, n_words binary, n_pairs binary, n_triples binary, total long, distinct long"


def _answer(key, asked):
    """Sums per key over all blocks, sent back to each block; block -1 gets the bucket's totals."""

    cols = {c: asked.column(c).to_pylist() for c in _SENT}

    def summed(keys: list[np.ndarray], counts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([expand(x, np.uint32) for x in counts]), minlength=len(names)).astype(np.uint64)
        parts = np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])
        return sums, [squeeze(p) for p in parts]

    (sums, words), (_, pairs), (_, triples) = (summed([expand_keys(x) for x in cols[k]], cols[f"n_{k}"]) for k in _KINDS)
    n, bucket = len(words), key[0].as_py()
    K.release()
    return pa.table({
        "block": pa.array([*asked.column("block").to_pylist(), -1], pa.int64()),
        "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "n_words": pa.array([*words, None], pa.binary()),
        "n_pairs": pa.array([*pairs, None], pa.binary()),
        "n_triples": pa.array([*triples, None], pa.binary()),
        "total": pa.array([None] * n + [int(sums.sum())], pa.int64()),
        "distinct": pa.array([None] * n + [int((sums > 0).sum())], pa.int64()),
    })


_RESULT = {
    "n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType(),
}


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at `starts`; floats in extended precision, so that order hardly matters."""
    if not len(starts):
        return np.zeros(0, values.dtype)
    wide = values.astype(np.longdouble) if values.dtype.kind == "f" else values
    return np.add.reduceat(wide, starts).astype(values.dtype)


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, tables: int = TABLE_BUCKETS) -> DataFrame:
    """`docs` (text, learn boolean, ...) without these two, plus the token counts and both scores.

    The model is learned from the rows where learn is true; all rows are scored.
    """
    size = text_bytes(docs)
    keep = [c for c in docs.columns if c not in ("text", "learn", *_RESULT)]
    kept = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
    rows = docs.select(kept.alias("row"), "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    blocks = store_as_read(rows, block_count(size, block_bytes), block_bytes, tables, level=6)
    sent = "bucket int, block long, " + ", ".join(f"{c} binary" for c in _SENT)
    buckets = bucket_count(size, BUCKET_BYTES) if size > LEAST_BUCKETS << 20 else max(1, size >> 20)
    asked = blocks.groupBy("block").applyInArrow(_ask(buckets), sent)
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER), "lm-counts")
    whole = answers.where("block = -1").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = (int(x or 0) for x in whole)
    schema = T.StructType([rows.schema["row"], *(T.StructField(k, v) for k, v in _RESULT.items())])

    def walk(blobs, got):
        rows, grams, _ = _block_rows(blobs)
        got = got.sort_by("bucket")
        counts = [np.concatenate([expand(x, np.uint64) for x in got.column(f"n_{k}").to_pylist()]).astype(np.int64) for k in _KINDS]
        for i, names in ((0, grams.words), (2, grams.triple_keys())):
            own = np.empty_like(counts[i])
            own[np.argsort(names)] = counts[i]
            counts[i] = own
        words = counts[0]
        base = np.log10((words + 1.0) / (total + distinct + 1.0))
        known = (words > 0)[grams.word].astype(np.int64)
        new = {
            "n_tokens": grams.stops - grams.starts,
            "n_known": _sums(known, grams.starts),
            "train_tokens": np.full(len(grams.stops), total, np.int64),
            "base_score": _sums(base[grams.word], grams.starts),
        }
        machine = BackoffAutomaton(grams, words, counts[1], counts[2], total, distinct)
        new["score"] = machine.read(grams.starts, grams.stops)
        del machine, grams, counts, known
        K.release()
        return pa.Table.from_arrays([rows.column("row"), *map(pa.array, new.values())], ["row", *new])

    mine = answers.where("block >= 0").select("block", "bucket", *(f"n_{k}" for k in _KINDS))
    out = blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(walk, schema)
    return out.select(*(["row.*"] if keep else []), *_RESULT)


def op3_lm_scoring(spark, sf_dir):
    """Scores are rounded to 7 decimals, so that the order of sums does not show."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 7, 2)
    out = score(docs.withColumn("held_out", held).withColumn("learn", ~held))
    scores = [F.round(c, 7).alias(c) for c in ("base_score", "score")]
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", *scores)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
         coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295::BIGINT) % 7 = 2, true) AS held_out
  FROM documents),
w AS (
  SELECT r, held_out, u.word, u.i FROM (SELECT r, held_out, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d) x,
         unnest(ws) WITH ORDINALITY AS u(word, i)
  UNION ALL SELECT r, held_out, '' AS word, 9000000000 AS i FROM d),
t AS (
  SELECT r, held_out, word, coalesce(lag(word) OVER o, ' ') AS b, CASE WHEN lag(word) OVER o IS NOT NULL THEN coalesce(lag(word, 2) OVER o, ' ') END AS a
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
c2 AS (SELECT b, word, count(*) AS c FROM t WHERE NOT held_out GROUP BY b, word),
c3 AS (SELECT a, b, word, count(*) AS c FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b, word),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1),
h AS (SELECT CASE WHEN word = '' THEN ' ' ELSE word END AS b, c FROM c1),
s AS (
  SELECT r, coalesce(c1.c, 0) AS k, n.n, n.v, t.a, coalesce(c2.c, 0) AS k2, coalesce(c3.c, 0) AS k3, coalesce(h.c, 0) AS h1, coalesce(p.c, 0) AS h2,
         CASE WHEN n.n = 0 THEN 1.0::DOUBLE WHEN c1.c > 0 THEN (c1.c - 0.7::DOUBLE) / n.n ELSE 0.7::DOUBLE * n.v / n.n END AS p1
  FROM t CROSS JOIN n LEFT JOIN c1 USING (word) LEFT JOIN c2 ON c2.b = t.b AND c2.word = t.word
  LEFT JOIN c3 ON c3.a = t.a AND c3.b = t.b AND c3.word = t.word LEFT JOIN h ON h.b = t.b LEFT JOIN c2 p ON p.b = t.a AND p.word = t.b),
q AS (SELECT *, (k2 + 1000 * p1) / (h1 + 1000)::DOUBLE AS p2 FROM s),
f AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (k > 0) AS n_known, max(n) AS n,
             fsum(log10((k + 1) / (n + v + 1)::DOUBLE)) AS base_score,
             fsum(log10(CASE WHEN a IS NULL THEN p2 ELSE (k3 + 3 * p2) / (h2 + 3)::DOUBLE END)) AS score
      FROM q GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 7) AS base_score, round(score, 7) AS score
FROM f JOIN d USING (r)
"""
