"""Shapes that are one ring are put together a batch at a time, to just what they are one by one."""

import numpy as np
from regionloom.operators import overlay


def box(x, y, w=1.0, h=1.0):
    return [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]]


def star(rng, n):
    turn, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1.5, n)
    return [[np.stack([far * np.cos(turn), far * np.sin(turn)], 1).tolist()]]


def made():
    rng = np.random.default_rng(5)
    at = lambda: float(rng.integers(0, 4))
    bow, there, holed = [[[[0, 0], [1, 1], [1, 0], [0, 1]]]], [[[[0, 0], [1, 0], [0, 0]]]], [[box(0.0, 0.0, 4.0, 4.0)[0][0], box(1.0, 1.0)[0][0]]]
    odd = [[[[0, 0], [float("nan"), 0], [0, 1]], [(0, 0), (1, 0), (0, 1)]]]
    rows = []
    for _ in range(60):
        rows += [[box(at(), at()), box(at(), at(), 2.0)], [box(at(), at()), box(at(), at()), box(at(), at())], [star(rng, int(rng.integers(3, 12)))], [star(rng, 9), star(rng, 7)]]
        rows += [[star(rng, overlay.MOST_PIECES + int(rng.integers(-1, 2)))], [bow], [there], [holed], [odd], [[]], [], [None, box(0.0, 0.0)], [box(-0.0, 0.0), box(1.0, 0.0, 1e-12)]]
    return rows


def test_batches_give_what_single_shapes_give():
    rows = made()
    a = overlay.Arrangement(overlay.edges_of_rows(rows), len(rows))
    row, xy = a.border(overlay.in_any)
    bounds = np.searchsorted(row, np.arange(len(rows) + 1))
    want = [overlay.assemble(xy[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    assert a.polygons(overlay.in_any) == want and sum(map(bool, want)) > 400
    assert overlay.unions([]) == [] and overlay.unions([[], [[]]]) == [[], []]


def test_only_other_shapes_are_put_together_one_by_one(monkeypatch):
    calls, plain = [], overlay.assemble
    monkeypatch.setattr(overlay, "assemble", lambda xy: calls.append(len(xy)) or plain(xy))
    rows = [[box(4.0 * k, 0.0, 0.5), box(4.0 * k + 0.5, 0.0, 0.5)] for k in range(500)]
    got = overlay.unions([*rows, [[[[[0, 0], [1, 1], [1, 0], [0, 1]]]]]])
    assert got[:2] == [box(0.0, 0.0), box(4.0, 0.0)] and len(got[-1]) == 2
    assert len(calls) == 1


def test_edges_of_rings():
    e = overlay.edges_of_rows([[box(0.0, 0.0)], [None, [[[(0, 0), (1, 0), (0, 1)], [(0, 0), (1, 1)], [(0, 0), (None, 1), (0, 2)]]]]])
    assert e.row.tolist() == [0] * 4 + [1] * 3 and e.bit.tolist() == [1] * 4 + [2] * 3
    assert e.xy[4:].tolist() == [[0, 0, 1, 0], [1, 0, 0, 1], [0, 1, 0, 0]]
