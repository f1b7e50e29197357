"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a smaller document.

The suffix arrays are built by linear grouping. Suffixes are grouped by their first symbol; groups
are taken in descending order, and every group moves the previous smaller suffixes of its members
(found by pointers) to new groups above their old ones, by how many members point to them. What
remains are the suffixes grouped by Lyndon prefix, in order. A second sweep emits each group's order:
going through the array as it fills, every suffix whose Lyndon prefix ends where the current one
begins takes the next place of its group. No level renames and recurses.

A suffix array needs its strings in one place, so strings are first brought together. In every
50-byte window the smallest of its 31 hashed 20-byte grams stands for it; windows in a row with the
same gram form a span, and equal windows have equal grams. Blocks of texts ask which grams occur in
two texts (see blocks.py), then send the distinct spans of those grams to the gram's bucket. There,
spans that have windows of one hash form a family, each cut to where such windows begin and end, the
suffix array of a family's spans brings equal windows together, and the smallest document of each goes
back. A span alone in its family needs no sorting.

Exactness. Hashes only bring strings together; what is equal is decided by bytes. Spans are told
apart by their bytes in blocks and buckets, windows by the suffix array and their bytes. Whole texts
that are equal (by SHA-256) are one text with its smallest id.

Scale. Everything is distinct per block before it moves. What would not fit a task's memory is cut to
single windows, which need no suffix array, since equal windows are then equal strings: a gram of more
than `HOT_SPANS` texts (a passage in a third of all) is not gathered, but its windows are dealt by their
own hash and told apart by their bytes; and so are the windows of a family of over `FAMILY_SYMBOLS`.

Edge cases. Null and empty texts have no bytes. A null id counts as the largest id; ids must be
integers (or text of them). Rows with equal id are one document. Repeated rows get equal results.
Texts under 50 bytes lose nothing. An empty table gives an empty result. Result columns replace input
columns of the same name; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import kernels as K
from .blocks import TABLE_BUCKETS, block_count, bucket_count, bucket_edges, differences, expand, expand_sorted, squeeze, store, unpack
from .common import materialize, table, text_bytes

LENGTH = 50
GRAM = 20
HOT_SPANS = 1000
PIECE = 256  # windows of a span at most: longer ones (periodic text) are cut
FAMILY_SYMBOLS = 1 << 16
BUCKET_BYTES = 16 << 20  # of text whose grams and spans a bucket can hold
_LAST = (1 << 63) - 1
_CHUNK = 1 << 17
U64 = np.uint64


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """Group starts (in suffix order) and previous-smaller pointers of all suffixes.

    `s` must end with a symbol that is smaller than all others.
    """
    n = len(s)
    counts = [0] * (max(s) + 2)
    for c in s:
        counts[c + 1] += 1
    first = list(accumulate(counts))
    group = [first[c] for c in s]
    slot = first[:]
    at, order = [0] * n, [0] * n
    for i, c in enumerate(s):
        order[slot[c]] = i
        at[i] = slot[c]
        slot[c] += 1
    size = [0] * n
    for g in group:
        size[g] += 1
    prev = [-1] * n
    end = n - 1
    while end > 0:
        i = order[end]
        start = group[i]
        if start == end:  # a group of one moves one suffix at most
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            end -= 1
            if j >= 0:
                g = group[j]
                if left := size[g] - 1:
                    size[g] = left
                    to = g + left
                    q, a = order[to], at[j]
                    order[a], at[q] = q, a
                    order[to] = j
                    at[j] = group[j] = to
                    size[to] = 1
            continue
        met: list[int] = []
        for i in sorted(order[start : end + 1]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                met.append(j)
        once = set(met)
        if len(once) == len(met):
            by_count = {1: met}
        else:
            by_count = {}
            for p, k in Counter(met).items():
                by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            shrunk: dict[int, int] = {}
            for p in by_count[k]:  # to the upper end of what is left of its group
                g = group[p]
                size[g] -= 1
                shrunk[g] = shrunk.get(g, 0) + 1
                to = g + size[g]
                q, a = order[to], at[p]
                order[a], at[q] = q, a
                order[to], at[p] = p, to
            for g, moved in shrunk.items():
                new = g + size[g]
                if new != g:
                    for x in range(new, new + moved):
                        group[order[x]] = new
                size[new] = moved
        end = start - 1
    return group, prev


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of `s`, whose last symbol must be smaller than all others."""
    if len(s) < 2:
        return list(range(len(s)))
    slot, prev = lyndon_groups(s)
    n = len(s)
    nxt = list(range(n))
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = slot[j]
            out[nxt[g]] = j
            nxt[g] += 1
            placed[j] = True
            j = prev[j]
    return out


def smallest_ids(spans: list[bytes], ids: list[int], grams: list[int] | None = None) -> list[list[int]]:
    """For every window of every span: the smallest id of the spans that hold the same window.

    `grams`: where in each span the same `GRAM` bytes stand, which all its windows hold; they are one symbol.
    """
    if sum(map(len, spans)) > FAMILY_SYMBOLS:
        return _smallest_by_windows(spans, ids)
    text = b"".join(spans) if grams is None else b"".join([x[: p + 1] + x[p + GRAM :] for x, p in zip(spans, grams)])
    codes = [c + 2 for c in text]  # bytes 0-255 become 2-257, a gram 258; 1 separates spans, 0 ends
    s: list[int] = []
    owner, inside, base, at = [], [], [], 0
    for k, x in enumerate(spans):
        base.append(len(s))
        n, windows = len(x) - (GRAM - 1 if grams else 0), len(x) - LENGTH + 1
        s += codes[at : at + n]
        s.append(1)
        if grams:
            s[base[k] + grams[k]] = 258
        owner += [k] * windows + [-1] * (n + 1 - windows)
        inside += range(windows)
        inside += [0] * (n + 1 - windows)
        at += n
    s.append(0)
    owner.append(-1)
    out = [[0] * (len(x) - LENGTH + 1) for x in spans]
    run: list[int] = []
    low, last = 0, None

    def close() -> None:
        for i in run:
            out[owner[i]][inside[i]] = low

    for i in suffix_array(s):
        k = owner[i]
        if k < 0:
            continue
        window = spans[k][inside[i] : inside[i] + LENGTH]
        if window != last:
            close()
            run, low, last = [], ids[k], window
        elif ids[k] < low:
            low = ids[k]
        run.append(i)
    close()
    return out


def _smallest_by_windows(spans: list[bytes], ids: list[int]) -> list[list[int]]:
    """The same by a dictionary of windows, which takes less memory than the suffix array."""
    low: dict[bytes, int] = {}
    for x, i in zip(spans, ids):
        for a in range(len(x) - LENGTH + 1):
            w = x[a : a + LENGTH]
            if low.get(w, i) >= i:
                low[w] = i
    return [[low[x[a : a + LENGTH]] for a in range(len(x) - LENGTH + 1)] for x in spans]


def _distinct(deal: np.ndarray, raw: bytes, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte strings raw[begin:stop] with ascending `deal`: the first of each that are equal, and which one each equals."""
    same = deal[1:] == deal[:-1]
    many = np.flatnonzero(np.r_[False, same] | np.r_[same, False])  # only these can equal another one
    head = np.arange(len(deal))
    seen: dict[bytes, int] = {}
    heads, last = [], -1
    for i, d, a, b in zip(many.tolist(), deal[many].tolist(), begin[many].tolist(), stop[many].tolist()):
        if d != last:
            seen, last = {}, d
        heads.append(seen.setdefault(raw[a:b], i))
    head[many] = heads
    first = np.flatnonzero(head == np.arange(len(deal)))
    return first, np.searchsorted(first, head)


def gram_hashes(buf: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of all k-byte grams, by doubling."""
    base, cur, length, at, out = 0x9E3779B97F4A7C15, buf.astype(U64) + U64(1), 1, 0, None
    n = len(buf) - k + 1
    while True:
        if k & length:
            part = cur[at : at + n]
            out = part if out is None else out * U64(pow(base, length, 1 << 64)) + part
            at += length
        if length * 2 > k:
            return K.mix(out)
        cur = cur[:-length] * U64(pow(base, length, 1 << 64)) + cur[length:]
        length *= 2


def gram_key(h: np.ndarray) -> np.ndarray:
    """What a gram is known by elsewhere: the smallest of many hashes is small, its key is spread evenly."""
    return K.mix(h ^ U64(0x5851F42D4C957F2D))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n, cur, length = len(h) - w + 1, h, 1
    while length * 2 <= w:
        cur = np.minimum(cur[:-length], cur[length:])
        length *= 2
    return np.minimum(cur[:n], cur[w - length : w - length + n]) if length < w else cur


class Block:
    """The distinct texts of a block, in order of id, and their spans."""

    def __init__(self, blobs: pa.Table):
        rows = unpack(blobs)
        low: dict[str, int] = {}
        for text, i in zip(rows.column("text").to_pylist(), rows.column("_id").to_pylist()):
            low[text] = min(i, low.get(text, i))
        pairs = sorted((i, t.encode("utf-8", "surrogatepass")) for t, i in low.items())
        self.ids = np.array([i for i, _ in pairs], np.int64)
        self.texts = [t for _, t in pairs]
        self.buf, self.starts, self.ends = K.joined(self.texts)
        self.raw = self.buf.base if isinstance(self.buf.base, bytes) else self.buf.tobytes()
        parts = [self._spans(a, b) for a, b in K.chunks(self.texts, _CHUNK)]
        self.gram, self.text_of, self.first, self.windows = (np.concatenate(x) for x in zip(*parts))

    def _spans(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """gram, text, first window, number of windows of each span of the texts a..b."""
        lo = self.starts[a]
        buf = self.buf[lo : self.ends[b - 1]]
        if len(buf) < LENGTH:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = _sliding_min(gram_hashes(buf), LENGTH - GRAM + 1)
        lengths = np.maximum(self.ends[a:b] - self.starts[a:b] - LENGTH + 1, 0)  # windows a text
        text = np.repeat(np.arange(a, b), lengths)
        at = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + self.starts[text]
        if not len(at):
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = low[at - lo]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
        cut = np.flatnonzero(new)
        n = np.diff(np.append(cut, len(m)))
        pieces = -(-n // PIECE)
        if (pieces > 1).any():
            part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cut, n = np.repeat(cut, pieces) + part * PIECE, np.minimum(np.repeat(n, pieces) - part * PIECE, PIECE)
        return gram_key(m[cut]), text[cut], at[cut], n

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of spans by gram, the grams in that order, and where a new gram begins."""
        order = np.argsort(self.gram, kind="stable")
        g = self.gram[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        return order, g, new

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams and the number of texts that hold each."""
        order, g, name = self._sorted()
        t = self.text_of[order]
        new = name.copy()
        new[1:] |= t[1:] != t[:-1]
        at = np.flatnonzero(name)
        return g[at], (np.add.reduceat(new.astype(np.int64), at) if len(at) else np.zeros(0, np.int64))

    def candidates(self, kind: np.ndarray):
        """Distinct candidate spans, given each gram's kind (0 in one text, 1 shared, 2 hot).

        Returns the key to deal by, the span's first occurrence's place and windows, the smallest id,
        and for all occurrences: their span, place, windows and text.
        """
        order, _, new = self._sorted()
        k = np.zeros(len(order), np.uint8)
        k[order] = kind[np.cumsum(new) - 1]
        warm, hot = np.flatnonzero(k == 1), np.flatnonzero(k == 2)
        each = self.windows[hot]  # a hot gram's spans become single windows
        offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        alone = np.repeat(self.first[hot], each) + offset
        own = np.fromiter((xxh64_intdigest(self.raw[a : a + LENGTH]) for a in alone.tolist()), U64, len(alone))
        deal = np.concatenate([self.gram[warm], own])
        order = np.argsort(deal, kind="stable")  # texts ascend by id: the first of equal spans has the smallest
        deal = deal[order]
        first = np.concatenate([self.first[warm], alone])[order]
        windows = np.concatenate([self.windows[warm], np.ones(len(alone), np.int64)])[order]
        text = np.concatenate([self.text_of[warm], np.repeat(self.text_of[hot], each)])[order]
        one, span = _distinct(deal, self.raw, first, first + windows + LENGTH - 1)
        return deal[one], first[one], windows[one], self.ids[text[one]], span, first, windows, text


def _ask_grams(buckets: int):
    def ask(key, blobs):
        names, counts = Block(blobs).grams()
        edges = bucket_edges(names, buckets)
        full = [i for i in range(buckets) if edges[i] < edges[i + 1]]
        cut = [slice(edges[i], edges[i + 1]) for i in full]
        keys, counts = differences(names, edges[full]), counts.astype(np.uint32)
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int64()),
            "keys": pa.array([squeeze(keys[c]) for c in cut], pa.binary()),
            "counts": pa.array([squeeze(counts[c]) for c in cut], pa.binary()),
        })

    return ask


def _answer_grams(hot: int):
    def answer(key, asked):
        keys = [expand_sorted(x) for x in asked.column("keys").to_pylist()]
        counts = np.concatenate([expand(x, np.uint32) for x in asked.column("counts").to_pylist()])
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(names))
        kind = ((total > 1).astype(np.uint8) + (total > hot))[at].astype(np.uint8)
        parts = np.split(kind, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "answer": pa.array(list(map(squeeze, parts)), pa.binary())})

    return answer


def _in_order(answers: pa.Table, kind) -> np.ndarray:
    got = answers.sort_by("bucket").column("answer").to_pylist()
    return np.concatenate([expand(x, kind) for x in got]) if got else np.zeros(0, kind)


def _ask_spans(buckets: int):
    def ask(key, blobs, answers):
        if not blobs.num_rows:
            blobs = None
        block = Block(blobs)
        deal, first, windows, ids, *_ = block.candidates(_in_order(answers, np.uint8))
        raw = block.raw
        edges = bucket_edges(deal, buckets)
        full = np.flatnonzero(edges[1:] > edges[:-1])
        out = {"bucket": [], "block": [], "deal": [], "windows": [], "ids": [], "spans": []}
        ends = np.concatenate([[0], np.cumsum(windows + LENGTH - 1)])
        text = b"".join([raw[f : f + n] for f, n in zip(first.tolist(), np.diff(ends).tolist())])
        keys, windows = differences(deal, edges[full]), windows.astype(np.uint16)
        for i, a, b in zip(full.tolist(), edges[full].tolist(), edges[full + 1].tolist()):
            spans = text[ends[a] : ends[b]]
            row = (i, key[0].as_py(), squeeze(keys[a:b]), squeeze(windows[a:b]), squeeze(ids[a:b]))
            for name, x in zip(out, (*row, len(spans).to_bytes(8, "little") + pa.compress(spans, codec="zstd", asbytes=True))):
                out[name].append(x)
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        K.release()
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return ask


def _families(raw: bytes, begin: np.ndarray, windows: np.ndarray, deal: np.ndarray):
    """Distinct spans (by ascending `deal`) that share windows, directly or by others, as families: for each the spans, the first and the
    number of windows that are left of each, and where its gram begins there (None, if one holds it more than once).

    Windows of different hashes differ, so no span shares what is left out: windows before its first and behind its last one whose
    hash comes again. The others are told apart by `smallest_ids`.
    """
    same = deal[1:] == deal[:-1]
    many = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    grams = np.flatnonzero(np.r_[True, deal[many][1:] != deal[many][:-1]]) if len(many) else many
    part = (np.cumsum(windows[many]) - windows[many])[grams] // _CHUNK
    for spans in np.split(many, grams[1:][part[1:] != part[:-1]]):  # whole grams, about _CHUNK windows at a time
        if len(spans):
            yield from _families_of(spans, raw, begin, windows, deal)


def _families_of(many: np.ndarray, raw: bytes, begin: np.ndarray, windows: np.ndarray, deal: np.ndarray):
    n, w = len(many), windows[many]
    length = w + LENGTH - 1
    start = np.cumsum(length) - length
    text = b"".join([raw[a:b] for a, b in zip(begin[many].tolist(), (begin[many] + length).tolist())])
    buf = np.frombuffer(text, np.uint8)
    of = np.repeat(np.arange(n), w)
    at = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w)
    h = gram_hashes(buf, LENGTH)[at + start[of]]
    order = np.argsort(h)
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    i, j = order[again], order[again + 1]
    met = np.zeros(len(h), bool)
    met[i] = met[j] = True
    first, last = np.full(n, len(buf)), np.full(n, -1)
    np.minimum.at(first, of[met], at[met])
    np.maximum.at(last, of[met], at[met])
    i, j = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for pair in np.unique(i * n + j).tolist():
        a, b = find(pair // n), find(pair % n)
        root[max(a, b)] = min(a, b)
    g = gram_hashes(buf)
    hit = np.flatnonzero(gram_key(g) == np.repeat(deal[many], length)[: len(g)])
    own = np.searchsorted(start, hit, side="right") - 1
    inside = hit + GRAM <= start[own] + length[own]
    hit, own = hit[inside], own[inside]
    single = np.bincount(own, minlength=n) == 1
    gram = np.zeros(n, np.int64)
    gram[own] = hit - start[own]
    families: dict[int, list[int]] = {}
    for k in np.flatnonzero(last >= 0).tolist():
        families.setdefault(find(k), []).append(k)
    for family in families.values():
        if len(family) < 2:
            continue
        k = np.array(family)
        at = (gram[k] - first[k]).tolist() if single[k].all() else None
        if at and len({text[a : a + GRAM] for a in (start[k] + gram[k]).tolist()}) > 1:
            at = None
        yield many[k].tolist(), first[k].tolist(), (last[k] - first[k] + 1).tolist(), at


def _answer_spans(key, asked):
    """For every span sent: the smallest id of each of its windows, as differences."""
    cols = {c: asked.column(c).to_pylist() for c in ("deal", "windows", "ids", "spans")}
    deal = [expand_sorted(x) for x in cols["deal"]]
    sizes = [len(x) for x in deal]
    deal = np.concatenate(deal)
    windows = np.concatenate([expand(x, np.uint16) for x in cols["windows"]]).astype(np.int64)
    ids = np.concatenate([expand(x, np.int64) for x in cols["ids"]])
    raw = b"".join(pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in cols.pop("spans"))
    length = windows + LENGTH - 1
    begin = np.cumsum(length) - length
    order = np.argsort(deal, kind="stable")
    first, which = _distinct(deal[order], raw, begin[order], (begin + length)[order])
    one = order[first]  # distinct spans, gram by gram
    span = np.empty(len(order), np.int64)
    span[order] = which
    least = np.full(len(one), _LAST)
    np.minimum.at(least, span, ids)
    place = np.cumsum(windows[one]) - windows[one]
    low = np.repeat(least, windows[one])
    d = deal[one]
    starts, values = begin[one].tolist(), least.tolist()
    for family, first, left, grams in _families(raw, begin[one], windows[one], d):
        spans = [raw[starts[i] + a : starts[i] + a + n + LENGTH - 1] for i, a, n in zip(family, first, left)]
        for i, a, found in zip(family, first, smallest_ids(spans, [values[i] for i in family], grams)):
            low[place[i] + a : place[i] + a + len(found)] = found
    ends = np.concatenate([[0], np.cumsum(windows)])
    shift = place[span] - ends[:-1]
    answers, at = [], 0
    for n in sizes:
        index = np.arange(ends[at], ends[at + n]) + np.repeat(shift[at : at + n], windows[at : at + n])
        answers.append(squeeze(differences(low[index])))
        at += n
    del raw, low
    K.release()
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "answer": pa.array(answers, pa.binary())})


_RESULT = "sha string, rep long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"


def _remove(with_text: bool):
    def remove(blobs, answers):
        block = Block(blobs)
        kinds = answers.filter(pa.compute.equal(answers.column("step"), 0))
        lows = answers.filter(pa.compute.equal(answers.column("step"), 1)).sort_by("bucket").column("answer").to_pylist()
        _, _, one_windows, _, span, first, windows, text = block.candidates(_in_order(kinds, np.uint8))
        low = np.concatenate([np.cumsum(expand(x, np.int64)) for x in lows]) if lows else np.zeros(0, np.int64)
        place = np.cumsum(one_windows) - one_windows
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        known = low[np.repeat(place[span], windows) + offset] < np.repeat(block.ids[text], windows)
        at = (np.repeat(first, windows) + offset)[known]
        starts = np.zeros(len(block.buf) + LENGTH + 1, bool)
        starts[at + 1] = True
        begun = np.cumsum(starts, dtype=np.int32)  # windows that start before a byte
        gone = np.zeros(len(block.buf) + 2, np.int8)
        gone[1:-1] = begun[1 : len(block.buf) + 1] > np.r_[np.zeros(LENGTH - 1, np.int32), begun][: len(block.buf)]
        step = np.diff(gone)
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        of_a, of_b = np.searchsorted(a, block.starts), np.searchsorted(a, block.ends)
        out: dict[str, list] = {n.split(" ")[0]: [] for n in _RESULT.replace("start:bigint,end", "").split(", ")}
        for i, raw in enumerate(block.texts):
            spans = [(int(x - block.starts[i]), int(y - block.starts[i])) for x, y in zip(a[of_a[i] : of_b[i]], b[of_a[i] : of_b[i]])]
            parts, p = [], 0
            for x, y in spans:
                parts.append(raw[p:x])
                p = y
            kept = b"".join([*parts, raw[p:]])
            row = (hashlib.sha256(raw).hexdigest(), int(block.ids[i]), len(raw) - len(kept), len(spans),
                   [{"start": x, "end": y} for x, y in spans] if with_text else None, kept if with_text else None, hashlib.sha256(kept).hexdigest())
            for name, x in zip(out, row):
                out[name].append(x)
        del known, at, starts, begun, gone, step, offset
        K.release()
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pair, pa.binary(), pa.string())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return remove


def _lowest_per_text(rows: pa.Table) -> pa.Table:
    """Of equal texts in a batch the row with the smallest id."""
    best: dict[str, int] = {}
    ids = rows.column("_id").to_pylist()
    for i, text in enumerate(rows.column("text").to_pylist()):
        if text not in best or ids[i] < ids[best[text]]:
            best[text] = i
    return rows.take(pa.array(list(best.values())))


def distinct_results(docs: DataFrame, with_text: bool = False, block_bytes: int | None = None, hot: int = HOT_SPANS, tables: int = TABLE_BUCKETS) -> DataFrame:
    """Per distinct text of `docs` (doc_id, text): its sha256, smallest id and what is removed from it in that document."""
    size = text_bytes(docs)
    n = block_count(size, block_bytes) if block_bytes else block_count(size)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"))
    blocks = store(rows, F.pmod(F.xxhash64("text"), F.lit(n)), n, _lowest_per_text, min(tables, max(8, n // 4)))
    buckets = bucket_count(size, BUCKET_BYTES)
    reply = "block long, bucket int, answer binary"
    asked = blocks.groupBy("block").applyInArrow(_ask_grams(buckets), "bucket int, block long, keys binary, counts binary")
    kinds = materialize(asked.groupBy("bucket").applyInArrow(_answer_grams(hot), reply), "gram-kinds")
    sent = "bucket int, block long, deal binary, windows binary, ids binary, spans binary"
    spans = blocks.groupBy("block").cogroup(kinds.groupBy("block")).applyInArrow(_ask_spans(buckets), sent)
    lows = materialize(spans.groupBy("bucket").applyInArrow(_answer_spans, reply), "span-lows")
    answers = kinds.withColumn("step", F.lit(0)).unionByName(lows.withColumn("step", F.lit(1)))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(with_text), _RESULT)


def dedup_substrings(docs: DataFrame, with_text: bool = False, block_bytes: int | None = None, hot: int = HOT_SPANS, tables: int = TABLE_BUCKETS) -> DataFrame:
    """`docs` without text, plus n_bytes, n_removed, n_spans and kept_sha256; with_text adds spans and kept.

    Documents whose text a smaller document has too lose all of it, if it has 50 bytes.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
    keep = [c for c in docs.columns if c not in ("text", *new)]
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.struct(*keep).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        F.sha2(text, 256).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    r = distinct_results(docs.select("doc_id", "text"), with_text, block_bytes, hot, tables)
    copy = (F.col("id") > F.col("rep")) & (F.col("n_bytes") >= LENGTH)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    more = [F.when(copy, span).otherwise(F.col("spans")).alias("spans"), F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")]
    out = [
        F.col("n_bytes"),
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *(more if with_text else []),
    ]
    return slim.join(r, "sha").select("row", F.struct(*out).alias("new")).select("row.*", "new.*")


def op8_suffix_array_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
low AS (SELECT r, i, id, min(id) OVER (PARTITION BY g) AS low FROM w),
new AS (SELECT r, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS new FROM low WHERE low < id WINDOW o AS (PARTITION BY r ORDER BY i)),
run AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM new) GROUP BY r, k),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM run),
gone AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
                string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
