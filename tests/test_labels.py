"""Labels inside, along and beside regions; letters on a path; legend places. Against the rules and an exhaustive search."""

import random

import numpy as np
import pytest
from regionloom.operators import labels as L


def rect(x0, y0, x1, y1):
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


WIDE = L.Options(bounds=(0, 0, 400, 400))


def test_letters_follow_the_path_centred():
    ls = L.letters([(0, 0), (100, 0), (100, 100)], "ab cd", 10.0)
    assert "".join(x[0] for x in ls) == "ab cd"
    assert ls[0][1:] == pytest.approx((100 - 14 + 2.8, 0, 0)) and ls[4][1:] == pytest.approx((100, 14 - 2.8, 90)) and ls[2][3] == pytest.approx(45)
    assert L.width("法國", 10) == 20 and L.width("France", 10) == pytest.approx(33.6) and L.width("서울", 10) == 20
    two = L.letters([(0, 0), (100, 0)], "a法", 10.0)
    assert two[1][1] - two[0][1] == pytest.approx(7.8)


def test_centred_labels_do_not_overlap():
    got = L.place([(1, "Alpha", rect(0, 0, 200, 100)), (2, "Beta", rect(200, 0, 400, 100)), (3, " ", rect(0, 200, 100, 300)), (4, "None", None)], WIDE)
    assert got.keys() == {1, 2} and (got[1].x, got[1].y) == pytest.approx((100, 50), abs=1)
    assert all(g.kind == "straight" and g.size == 11 for g in got.values())


def test_text_shrinks_to_fit():
    w = L.width("Longname", 11 * 0.8)
    got = L.place([(1, "Longname", rect(0, 0, w + 1, 30))], L.Options(leaders=False, bounds=(0, 0, 400, 400)))
    assert 7.7 - 1e-9 <= got[1].size < 11
    assert not L.place([(1, "Longname", rect(0, 0, w + 1, 30))], L.Options(leaders=False, min_scale=1.0))


def test_small_regions_get_leaders_over_empty_space_only():
    tiny = rect(195, 195, 199, 199)
    got = L.place([(1, "Tiny", tiny)], WIDE)
    assert got[1].kind == "leader" and got[1].path[0] == pytest.approx((197, 197)) and got[1].x > 197
    assert not L.place([(1, "Tiny", tiny)], L.Options(leaders=False))
    assert not L.place([(1, "Tiny", tiny), (2, "", rect(0, 0, 400, 400))], WIDE)
    box = got[1].boxes()[0]
    other = L.place([(1, "Tiny", tiny)], WIDE, [box])
    assert other[1].x < 197  # the right is reserved


def test_long_thin_regions_get_curved_labels_in_reading_order():
    got = L.place([(1, "Chile", rect(100, 0, 118, 400))], WIDE)
    assert got[1].kind == "curved" and got[1].path[0][1] > got[1].path[-1][1]  # from bottom to top
    flat = L.place([(1, "A long name", rect(0, 100, 400, 113))], WIDE)
    assert flat[1].kind in ("straight", "curved") and flat[1].size == 11
    assert L.Shape(rect(0, 0, 40, 20)[0]).centreline() is None
    thin = L.place([(1, "Chile", rect(100, 0, 111, 400))], L.Options(leaders=False))
    assert thin[1].kind == "curved" and thin[1].size == pytest.approx(9.35)


def test_poles():
    c = [(0, 0), (100, 0), (100, 20), (20, 20), (20, 80), (100, 80), (100, 100), (0, 100), (0, 0)]
    (x, y), d = L.Shape([c]).pole(0.1)
    assert x < 20 and 11 < d < 12
    holed = L.Shape([rect(0, 0, 10, 10)[0][0], rect(3, 3, 7, 7)[0][0]])
    assert holed.area == 84 and not holed.inside(np.array([[5.0, 5.0]]))[0] and holed.inside(np.array([[1.0, 1.0]]))[0]
    p, d = holed.pole(0.01)
    assert holed.inside(np.array([p]))[0] and d == pytest.approx(3 * 2**0.5 / (1 + 2**0.5), abs=0.02)


def test_half_a_map_of_land():
    land = np.arange(400).reshape(20, 20) % 20 < 10
    got = {s[0]: s[1:] for s in L.slots(land, land.copy(), 6.0)}
    assert got["middle-right"] == (60.0, 6.0, 54.0, 108.0, 0.0) and got["top-left"][2:] == (0.0, 0.0, 1.0) and len(got) == 9
    areas = [s[3] * s[4] for s in L.slots(land, land.copy(), 6.0)]
    assert areas == sorted(areas, reverse=True)
    used, solid = land.copy(), land.copy()
    for g in (used, solid):
        L.mark(g, (72, 72, 120, 120), 6.0)
    got = {s[0]: s[1:] for s in L.slots(solid, used, 6.0)}
    assert got["bottom-right"][2:] == (0.0, 0.0, 1.0) and got["top-right"][1] + got["top-right"][3] <= 72 and got["top-right"][2] >= 48
    strip = np.arange(400).reshape(20, 20) % 20 < 14
    assert all(s[3] == 0 for s in L.slots(strip, strip.copy(), 6.0))


def test_slots_are_the_largest_there_are():
    rng = random.Random(5)
    used = np.array([[rng.random() < 0.03 for _ in range(24)] for _ in range(18)])
    for name, x, y, w, h, _ in L.slots(used, used, 10.0):
        ax, ay = next((i, j) for n, i, j in L.POSITIONS if n == name)
        start = lambda a, size, whole: (1, (whole - size) // 2, whole - 1 - size)[a]
        best = 0
        for ww in range(5, 23):
            for hh in range(5, 17):
                r, c = start(ay, hh, 18), start(ax, ww, 24)
                if not used[r : r + hh, c : c + ww].any():
                    best = max(best, ww * hh)
        assert w * h == best * 100
        assert not used[int(y / 10) : int((y + h) / 10), int(x / 10) : int((x + w) / 10)].any()


def test_maps_on_spark(spark):
    rows = [(m, i, t, [[[list(map(float, p)) for p in r] for r in part] for part in g] if g else None) for m in (1, 2) for i, t, g in [(1, "Alpha", rect(0, 0, 200, 100)), (2, "Tiny", rect(300, 300, 303, 303)), (3, "x", None)]]
    df = spark.createDataFrame(rows, "map long, id long, text string, geometry array<array<array<array<double>>>>")
    reserved = spark.createDataFrame([(2, 0.0, 0.0, 200.0, 100.0)], "map long, x0 double, y0 double, x1 double, y1 double")
    got = {(r["map"], r["id"]): r["kind"] for r in L.place_labels(df, WIDE, reserved).collect()}
    assert got == {(1, 1): "straight", (1, 2): "leader", (2, 2): "leader"}
    assert L.place_labels(df.limit(0)).count() == 0


def test_panels_by_language(spark):
    kind = "array<array<array<array<double>>>>"
    shape = lambda *b: [[[list(map(float, p)) for p in r] for r in part] for part in rect(*b)]
    subject = spark.createDataFrame([(1, 1, "Alpha", {"fr": "Un nom beaucoup trop long pour elle"}, shape(0, 0, 100, 100)), (1, 2, "Beta", None, shape(200, 0, 300, 100)), (2, 1, "Solo", {}, None)], f"map long, id long, name string, names map<string,string>, geometry {kind}")
    places = spark.createDataFrame([(1, 1, "Capital", {"fr": "Capitale"}, 150.0, 50.0), (1, 2, "Twin", None, 50.0, 85.0)], "map long, id long, name string, names map<string,string>, x double, y double")
    context = spark.createDataFrame([(1, 7, "Near", None, shape(0, 200, 300, 300))], f"map long, id long, name string, names map<string,string>, geometry {kind}")
    got = {(r["map"], r["lang"], r["layer"], r["id"]): r for r in L.panel_labels(subject, places, context, ["fr"], L.Options(bounds=(0, 0, 400, 400))).collect()}
    assert got[1, "", "region", 2]["text"] == "Beta" and got[1, "fr", "place", 1]["text"] == "Capitale" and got[1, "", "place", 1]["size"] == pytest.approx(11 * 0.85)
    assert got[1, "", "context", 7]["size"] == pytest.approx(9.9)
    assert (1, "fr", "region", 1) not in got and (1, "", "region", 1) in got  # too long for its region, which is too wide for a leader
    assert not any(k[0] == 2 for k in got)
    for lang in ("", "fr"):
        boxes = [L.outline(L.Label(r["text"], r["kind"], r["x"], r["y"], r["size"], r["path"])) for k, r in got.items() if k[1] == lang]
        assert all(a is b or a[0] > b[2] or b[0] > a[2] or a[1] > b[3] or b[1] > a[3] for a in boxes for b in boxes)
        assert all(not (b[0] <= x + 3 and x - 3 <= b[2] and b[1] <= y + 3 and y - 3 <= b[3]) for x, y in ((50, 85), (150, 50)) for b in boxes)
    taken = spark.createDataFrame([(1, 0.0, 0.0, 400.0, 400.0)], "map long, x0 double, y0 double, x1 double, y1 double")
    assert L.panel_labels(subject, places, context, [], L.Options(), taken).where("map = 1").count() == 0
