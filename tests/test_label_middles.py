"""Poles and centrelines come with the regions; a map's own task only places names."""

import pandas as pd
from regionloom.operators import labels


def _box(x, y, w, h):
    return [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]


def test_known_middles(spark, monkeypatch):
    regions = [(1, "North", [_box(0.0, 0.0, 120.0, 44.0)]), (2, "Long Strip", [_box(200.0, 0.0, 18.0, 400.0), _box(300.0, 0.0, 3.0, 3.0)]), (3, "None", None)]
    plain = labels.place(regions, labels.Options())
    m = labels.middles(True).func(pd.Series([g for _, _, g in regions]))
    known = {i: labels.middle_of(p, line) for (i, _, _), p, line in zip(regions, m["pole"], m["line"])}
    monkeypatch.setattr(labels.Shape, "pole", None)
    monkeypatch.setattr(labels.Shape, "centreline", None)
    assert labels.place(regions, labels.Options(), (), known) == plain
    assert (plain[1].kind, plain[1].x, plain[1].y, plain[2].kind) == ("straight", 60.0, 22.0, "curved")
