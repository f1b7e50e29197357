"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut by a pattern, each piece is encoded on its own. A piece's leaves are its byte
positions; the leaf of a live token holds the rank of the pair that it forms with the next one, and
every inner node the smallest (rank, position) of its up to `FAN` children. The least of the top is thus
the leftmost pair of minimum rank. Merging it kills one leaf and changes the pairs at two live
neighbours: three point updates of logarithmic cost, so a piece of n bytes takes O(n log n) however long
it is. Most pieces have fewer than `FAN` bytes, whose tree is one node.

Pieces repeat, so each task remembers the encodings of recent ones in two generations of bounded
size (in bytes, estimated). Ranks come from a vocabulary file named by a parameter; no special tokens exist.
Results leave the worker in slices of bounded text size.

Edge cases. Null and empty texts have no tokens and decode to no bytes. Repeated rows get equal
results. Result columns replace input columns of the same name. An empty table has an empty result. A very
long text is encoded whole, piece by piece; a task holds one text with its ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_BYTES = 24 << 20  # of each of two generations
SLICE_BYTES = 1 << 20
FAN = 32
_NONE = 1 << 62
_SHIFT = 32
_AT = (1 << _SHIFT) - 1

_FIELDS = {
    "ids": T.ArrayType(T.IntegerType()),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank = ranks.get
    leaves = [_NONE] * n
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            leaves[i] = r << _SHIFT | i
    tree = [leaves]
    while len(tree[-1]) > FAN:
        tree.append([min(tree[-1][a : a + FAN]) for a in range(0, len(tree[-1]), FAN)])
    top, deep = tree[-1], len(tree) > 1
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def risen(k: int) -> None:
        """The nodes above leaf k made right again."""
        for below, above in zip(tree, tree[1:]):
            k //= FAN
            best = min(below[k * FAN : (k + 1) * FAN])
            if above[k] == best:
                return
            above[k] = best

    while (best := min(top)) != _NONE:
        i = best & _AT
        j = after[i]
        after[i] = k = after[j]
        leaves[j] = leaves[i] = _NONE
        if k < n:
            before[k] = i
            r = rank(piece[i : after[k]])
            if r is not None:
                leaves[i] = r << _SHIFT | i
        h = before[i]
        if h >= 0:
            r = rank(piece[h:k])
            leaves[h] = _NONE if r is None else r << _SHIFT | h
        if deep:
            risen(j)
            risen(i)
            if h >= 0:
                risen(h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memory of pieces."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE_BYTES):
        import regex

        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.names = list(map(str, range(len(self.tokens))))
        self.pieces = regex.compile(pattern).findall
        self.limit, self.young, self.old, self.held = cache, {}, {}, 0

    def _piece(self, piece: str) -> list[int]:
        ids = self.old.get(piece)
        if ids is None:
            ids = merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= 64:
            if self.held >= self.limit:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[piece] = ids
            self.held += 230 + len(piece) + 8 * len(ids)
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.young.get
        for piece in self.pieces(text):
            ids = known(piece)
            if ids is None:
                ids = self._piece(piece)
                known = self.young.get
            out += ids
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def tokenize(docs: DataFrame, path: str, pattern: str, columns: Sequence[str] = tuple(_FIELDS), carry_text: bool = True) -> DataFrame:
    """`docs` (with a text column) plus the named ones of ids, n_tokens, ids_sha256, decoded_sha256.

    The digests are of the decimal ids joined by commas and of the bytes decoded from the ids. Without
    `carry_text` the texts do not travel back.
    """
    keep = [c for c in docs.columns if c not in columns and (carry_text or c != "text")]

    def encoded(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        new: dict[str, list] = {c: [] for c in columns}
        for text in part.column("text"):
            ids = codec.encode(text.as_py() or "")
            if "ids" in new:
                new["ids"].append(np.array(ids, np.int32))
            if "n_tokens" in new:
                new["n_tokens"].append(len(ids))
            if "ids_sha256" in new:
                new["ids_sha256"].append(hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
            if "decoded_sha256" in new:
                new["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        arrays = [pa.array(new[c], kinds.get(c, pa.string())) for c in columns]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], [*keep, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            for a, b in K.slices(batch.column("text"), SLICE_BYTES):
                yield encoded(codec, batch.slice(a, b - a))
            K.release()
        del codec
        K.release()

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, _FIELDS[c]) for c in columns])
    return docs.mapInArrow(run, schema)


def detokenize(rows: DataFrame, path: str) -> DataFrame:
    """`rows` (with an ids column) plus decoded, the bytes that the ids stand for (null ids: null)."""
    keep = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, "", 0)
        for batch in batches:
            out = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())]))


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokenize(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"), False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
