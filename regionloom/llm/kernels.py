"""Vectorised text kernels (NumPy) used inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    solid = np.zeros(len(buf) + 2, np.int8)
    solid[1:-1] = ~IS_BLANK[buf]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words_of(text: bytes, lower: bool = False) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time (a longer word in one)."""
    a = 0
    while a < len(text):
        b = a + (1 << 20)
        while b < len(text) and not IS_BLANK[text[b]]:
            b += 1
        part = text[a:b]
        yield (part.lower() if lower else part).split()  # bytes: ASCII blanks, A-Z
        a = b


def release() -> None:
    """Give memory that is free but held by the allocators back to the system; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of about `limit` bytes, one text at least."""
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, a = np.cumsum(size + 64), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def chunks(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of the list with at most `limit` bytes each, one text at least."""
    a = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x) > limit:
            yield a, i
            a, total = i, 0
        total += len(x) + 1
    if a < len(texts):
        yield a, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a line feed; starts and ends of the texts in it."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    return buf, ends - lengths, ends


def per_text(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of `values` over [start, end) for each text."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]
