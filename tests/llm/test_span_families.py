"""Suffix arrays are built of what spans may share, not of all that stands around a common gram."""

import random

import numpy as np
import pyarrow as pa
import pytest
from regionloom.llm import suffix as S
from regionloom.llm.blocks import _blob, differences, expand, expand_sorted, squeeze, squeeze_sorted

LETTERS = "abcdefghijklmnopqrstuvwxyz    "


def answered(texts, monkeypatch):
    """Windows of the spans of `texts` (ids 0, 1, ...), their smallest ids as answered, and the symbols that suffix arrays sorted."""
    rows = pa.table({"text": pa.array(texts), "_id": pa.array(range(len(texts)), pa.int64())})
    blobs = pa.table({"blob": pa.array([_blob(rows)], pa.binary())})
    block = S.Block(blobs)
    grams, counts = block.grams()
    kinds = pa.table({"bucket": pa.array([0], pa.int32()), "answer": pa.array([S.squeeze((counts > 1).astype("uint8"))], pa.binary())})
    asked = S._ask_spans(1)((pa.scalar(0),), blobs, kinds)
    sizes, plain = [], S.suffix_array
    monkeypatch.setattr(S, "suffix_array", lambda s: sizes.append(len(s)) or plain(s))
    got = S._answer_spans(None, asked).column("answer")[0].as_py()
    _, first, windows, ids, *_ = block.candidates((counts > 1).astype("uint8"))
    at = [(a + i, k) for a, w, k in zip(first.tolist(), windows.tolist(), ids.tolist()) for i in range(w)]
    return [block.raw[a : a + S.LENGTH] for a, _ in at], [k for _, k in at], expand(got, "int64").cumsum().tolist(), sum(sizes)


def test_spans_without_a_common_window(monkeypatch):
    """48 bytes in common are no window of 50: nothing is sorted."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    phrases = [word(48) for _ in range(5)]
    windows, ids, got, symbols = answered([word(60) + c + p + c.upper() + word(60) for p in phrases for c in "abcdefghijklmnopqrstuvwxyz"], monkeypatch)
    assert windows and got == ids and symbols == 0


@pytest.mark.parametrize("chunk", [1 << 17, 40])
def test_common_windows(monkeypatch, chunk):
    monkeypatch.setattr(S, "_CHUNK", chunk)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    passage, twice = word(200), word(30) * 4
    texts = []
    for _ in range(60):
        a = rng.randint(0, 100)
        texts.append(word(40) + rng.choice((passage[a : a + rng.randint(55, 100)], twice[a % 60 : a % 60 + 60], "é" * a)) + word(40))
    windows, ids, got, symbols = answered(texts, monkeypatch)
    low = {}
    for w, k in zip(windows, ids):
        low[w] = min(k, low.get(w, k))
    assert got == [low[w] for w in windows]
    assert any(g < k for g, k in zip(got, ids)) and symbols


def test_differences_of_parts():
    rng = np.random.default_rng(3)
    a, starts = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64)), np.array([0, 1, 70, 71, 400])
    parts = np.split(differences(a, starts), starts[1:])
    assert [p.cumsum(dtype=np.uint64).tolist() for p in parts] == [p.tolist() for p in np.split(a, starts[1:])]
    assert [squeeze(p) for p in parts] == [squeeze_sorted(p) for p in np.split(a, starts[1:])]
    assert expand_sorted(squeeze_sorted(a)).tolist() == a.tolist() and differences(a[:0], starts[:0]).tolist() == []
