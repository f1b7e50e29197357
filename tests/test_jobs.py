"""Selections, ids taken over, layer checks, batches; simplification against the plain rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from regionloom.operators import jobs, naming, rings
from regionloom.sources import tables

SHAPE = "array<array<array<array<double>>>>"


def square(x, y, w=1.0, h=None):
    h = w if h is None else h
    return [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]]


def test_selections(spark):
    regions = [("FR", 0, "France", ["république"]), ("LU", 0, "Luxembourg", None), ("BE-WLX", 1, "Luxembourg", None), ("FR-59", 1, "Nord", None), ("HT-ND", 1, "Nord", None),
               ("FR-62", 1, "Pas-de-Calais", None), ("US-NY", 1, "New York", None), ("world", 0, "World", None)]
    said = [(1, 0, "Nord"), (1, 1, "Pas-de-Calais"), (2, 0, "Nord"), (2, 1, "ht-nd"), (3, 0, "luxembourg"), (4, 0, "New York (state)"), (5, 0, "Nowhere"), (5, 1, "FR"), (6, 0, "world"), (6, 1, "FR"), (7, 0, " RÉPUBLIQUE "), (7, 1, "fr"), (8, 0, None)]
    r = spark.createDataFrame(regions, "code string, level int, name string, aliases array<string>")
    i = spark.createDataFrame(said, "sel int, pos int, input string")
    picked = jobs.pick_regions(i, r)
    got = {(x["sel"], x["pos"]): x["code"] for x in picked.collect()}
    assert got == {(1, 0): "FR-59", (1, 1): "FR-62", (2, 0): "HT-ND", (2, 1): "HT-ND", (3, 0): "LU", (4, 0): "US-NY", (5, 0): None, (5, 1): "FR", (6, 0): "world", (6, 1): "FR", (7, 0): "FR", (7, 1): "FR", (8, 0): None}
    codes = {x["sel"]: (x["code"], x["error"]) for x in jobs.selections(picked).collect()}
    assert codes[1] == ("FR-59,FR-62", None) and codes[2] == ("HT-ND", None) and codes[5] == (None, "no region Nowhere")
    assert codes[6] == (None, "world can't be combined with other regions") and codes[7] == ("FR", None)
    assert jobs.pick_regions(i.limit(0), r).count() == 0


def test_ids_of_the_same_places(spark):
    records = [(0, square(0, 0)), (1, square(5, 0)), (2, square(0, 0)), (3, None), (4, square(20, 20))]
    refs = [("A", "P", square(0.1, 0)), ("B", None, square(5.6, 0)), ("C", "P", square(0.2, 0)), ("D", None, None)]
    rec = spark.createDataFrame([(i, [[[list(map(float, p)) for p in r] for r in part] for part in g] if g else None, f"n{i}" if i != 4 else None) for i, g in records], f"pos long, geometry {SHAPE}, name string")
    ref = spark.createDataFrame([(c, p, [[[list(map(float, q)) for q in r] for r in part] for part in g] if g else None) for c, p, g in refs], f"code string, parent string, geometry {SHAPE}")
    taken = jobs.take_ids(rec, ref, 0.5)
    assert {r["pos"]: (r["code"], r["parent"], r["reused"]) for r in taken.collect()} == {0: ("A", "P", False), 1: (None, None, False), 2: ("A", "P", True), 3: (None, None, False), 4: (None, None, False)}
    assert tuple(jobs.take_report(taken, F.col("name"), 2).first()) == (2, 5, 1, "n1, n3 and 1 more")
    assert tuple(jobs.take_report(jobs.take_ids(rec, ref.limit(0)), F.col("name")).first())[:3] == (0, 5, 0)


def test_a_layers_issues(spark):
    bow = [[[[0.0, 50.0], [1.0, 51.0], [1.0, 50.0], [0.0, 51.0], [0.0, 50.0]]]]
    shapes = [(1, "a", square(0.0, 0.0)), (2, "b", square(0.5, 0.0)), (3, "c", square(20.0, 0.0)), (4, "d", square(21.00005, 0.0)), (5, "d", []), (6, "f", square(-170.0, 0.0, 0.01, 0.00001)), (7, "g", bow), (8, "h", square(179.5, 0.0)), (9, "i", None)]
    df = spark.createDataFrame(shapes, f"feature long, id string, geometry {SHAPE}")
    found = {(r["feature"], r["kind"], r["detail"], r["other"]) for r in jobs.check_layer(df).collect()}
    assert {(1, "overlap", "500", "2"), (3, "near_miss_border", "4", "4"), (4, "duplicate_id", None, None), (5, "duplicate_id", None, None), (5, "empty", None, None), (9, "empty", None, None)} <= found
    assert {(6, "sliver", None, None), (7, "invalid", "edges cross", None), (8, "out_of_range", None, None)} <= found
    assert {f for f, k, *_ in found if k in ("overlap", "near_miss_border", "invalid")} == {1, 3, 7}
    assert jobs.check_layer(df.limit(0)).count() == 0


def test_a_batch_goes_on_after_failures(spark):
    rows = [("x", "1", 1), ("x", "1", 2), ("x", "2", -1), ("y", "1", 5), ("y", "2", 7), ("z", "9", 8), ("z", "8", 9)]
    df = spark.createDataFrame(rows, "file string, region string, v int")

    def render(g):
        if (g["v"] < 0).any():
            raise KeyError("negative")
        return str(int(g["v"].sum()))

    name = F.when(F.col("file") == "z", "same").otherwise(naming.file_name("file", "region"))
    out = jobs.run_batch(df, render, name)
    got = {(r["file"], r["region"]): (r["name"], r["features"], r["output"], r["error"]) for r in out.collect()}
    assert got["x", "1"] == ("x_1", 2, "3", None) and got["x", "2"] == ("x_2", 1, None, "KeyError: 'negative'")
    assert got["z", "9"][2:] == (None, "same is the name of several jobs") == got["z", "8"][2:]
    assert tuple(jobs.batch_report(out, F.col("file") == "y").first()) == (3, 3, "y_1, y_2")


def test_picker_and_bridge(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r["id"] for r in jobs.picker(ids("a", "b"), ids("c"), ids("b", "c")).collect()} == {"b"}
    assert {r["id"] for r in jobs.picker(ids("a"), ids("c", "d"), ids("b", "c")).collect()} == {"c"}
    old = spark.createDataFrame([("o1", "t1", 5), ("o1", "t1", 1), ("o1", "t2", 2), ("o2", "t3", 9)], "old string, town string, land long")
    new = spark.createDataFrame([("n1", "t1"), ("n1", "t1"), ("n2", "t2")], "new string, town string")
    assert {tuple(r) for r in jobs.bridge(old, new, ("old", "new"), "town", "land").collect()} == {("o1", "n1", 6), ("o1", "n2", 2)}


@pytest.mark.parametrize("seed", range(4))
def test_simplification_takes_the_smallest_triangle_first(seed):
    """Against looking at all triangles again after every removal; a vertex counts at least as much as the last one removed."""
    rng = random.Random(seed)
    p = [(float(i), rng.uniform(0, 3)) for i in range(60)]
    for epsilon in (0.1, 0.5, 2.0):
        left, floor = list(range(60)), {}

        def area(k):
            a, b, c = (p[left[j]] for j in (k - 1, k, k + 1))
            return max(abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2, floor.get(left[k], 0.0))

        while len(left) > 2:
            k = min(range(1, len(left) - 1), key=lambda k: (area(k), left[k]))
            low = area(k)
            if low > epsilon:
                break
            for j in (k - 1, k + 1):
                floor[left[j]] = low
            del left[k]
        assert rings.simplify(np.array(p), epsilon).tolist() == [list(p[i]) for i in left]


def test_texts_of_quoted_cells(spark):
    text = '\ufeffcode;"the name";x\r\n1;"Dukes; and ""Nantucket""";a\r\n\r\n2;"two\nlines"\r\n ; ;\r\n3;c;d'
    df = spark.createDataFrame([(7, text), (8, None), (9, ""), (10, "code")], "k long, t string")
    got = [tuple(r) for r in tables.parse_text(df, "t", ["code", "the name", "x", "none"]).orderBy("line_no").collect()]
    assert got == [(7, 1, "1", 'Dukes; and "Nantucket"', "a", None), (7, 3, "2", "two\nlines", None, None), (7, 6, "3", "c", "d", None)]
    with pytest.raises(ValueError, match="not closed"):
        tables.records('a,b\n1,"open')


def test_descriptions(spark):
    long = "word " * 100
    rows = [
        ("Blank map.svg", "x", None, None), ("France location map.svg", "France", "", None), ("A.svg", "Peru", "Made; processed using tools", True), ("A.svg", "Peru", "Own <b>text</b>.", True),
        ("Relief of B.svg", "B", None, None), ("B in 1890.svg", "B", None, None), ("B provinces region.svg", "B", None, None), ("B.svg", "B", None, None),
        ("My_odd--map.svgz", naming.UNCLEAR, None, None), ("C.svg", "C", long, None), ("C.svg", "C", f"A head, based on {long}", None), ("C.svg", "C", "x" * 500, None),
    ]
    df = spark.createDataFrame(rows, "t string, a string, d string, l boolean")
    got = [r[0] for r in df.select(naming.short_description(F.col("t"), F.col("a"), F.col("d"), F.col("l"))).collect()]
    assert got[0] == naming.TEMPLATE and got[1] == naming.LOCATES.format("France") and got[2] == naming.LOCATES.format("Peru") and got[3] == "Own text."
    assert got[4].startswith("Physical") and got[5].startswith("Historical") and got[6].startswith("Political") and got[7].startswith("Outline map of B")
    assert got[8] == "Blank-map file titled “My odd map”; its coverage is unclear from Commons metadata."
    assert got[9] == "word " * 82 + "word..." and len(got[9]) <= 420 and got[10] == "A head" and got[11] == "x" * 417 + "..."


def test_names_credits_and_variables(spark):
    df = spark.createDataFrame([("Countries", "A", "2020"), (" own ", None, "2020"), ("states", "A", None), (None, None, None)], "d string, c string, y string")
    got = [tuple(r) for r in df.select(naming.dataset_name(F.col("d")), naming.credit_of_year(F.col("c"), F.col("y"))).collect()]
    assert got == [("ne-admin0", "A; boundaries as of 2020"), ("own", "Boundaries as of 2020"), ("ne-admin1", "A"), (None, None)]
    runs = spark.createDataFrame([("fra", "FR", "ADM1", "2019", "c"), ("deu", None, None, None, None)], "stem string, code string, sidecar_level string, sidecar_year string, credit string")
    names = spark.createDataFrame([("FR", "France")], "id string, name string")
    vars_ = {r["stem"]: r["vars"] for r in naming.template_variables(runs, names, "ADM0").collect()}
    assert vars_["fra"] == {"code": "FR", "name": "France", "level": "ADM1", "year": "2019", "stem": "fra", "data": "c"}
    assert vars_["deu"] == {"code": "deu", "name": "deu", "level": "ADM0", "year": "", "stem": "deu", "data": ""}


def test_nested_collections(spark):
    from regionloom.sources import geojson

    poly = '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}'
    line = '{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}'
    inner = f'{{"type": "GeometryCollection", "geometries": [{poly}, {line}, {{"type": "Point", "coordinates": [1, 2]}}]}}'
    outer = f'{{"type": "GeometryCollection", "geometries": [{inner}, {poly}, {inner}]}}'
    df = spark.createDataFrame([(g,) for g in (poly, line, inner, outer, '{"type": "Point", "coordinates": [1, 2]}')], "g string")
    got = [tuple(r) for r in df.select(F.size(geojson.polygons(F.col("g"))), F.size(geojson.lines(F.col("g")))).collect()]
    assert got == [(1, 0), (0, 1), (1, 1), (3, 2), (0, 0)]


def test_a_layer_is_converted(spark):
    bow = [[[[30.0, 0.0], [31.0, 1.0], [31.0, 0.0], [30.0, 1.0], [30.0, 0.0]]]]
    rec = spark.createDataFrame([(0, "Alpha", square(0.0, 0.0)), (1, "Beta", square(1.00005, 0.0)), (2, "Gamma", bow), (3, "Delta", None)], f"pos long, name string, geometry {SHAPE}")
    ref = spark.createDataFrame([("US-31", "US-1", square(0.1, 0.0)), ("US-99", "US-2", square(1.1, 0.0))], f"code string, parent string, geometry {SHAPE}")
    table = spark.createDataFrame([("Gamma", "G"), ("Delta", "D1"), ("Delta", "D2")], "key string, value string")
    names = spark.createDataFrame([("1", "Nebraska")], "key string, value string")
    out, told = jobs.convert(rec, 1e-4, ref, 0.5, (table, F.col("name")), names, "US-")
    got = {r["name"]: r for r in out.collect()}
    assert {n: (r["code"], r["parent"], r["parent_name"]) for n, r in got.items()} == {"Alpha": ("US-31", "US-1", "Nebraska"), "Beta": ("US-99", "US-2", None), "Gamma": ("G", None, None), "Delta": (None, None, None)}
    assert len(got["Gamma"]["geometry"]) == 2 and got["Delta"]["geometry"] is None and min(p[0] for p in got["Beta"]["geometry"][0][0]) == 1.0
    said = {r["step"]: (r["done"], r["total"], r["detail"]) for r in told.collect()}
    assert said["ids"] == (2, 4, "0 codes used again; unmatched: Gamma, Delta") and said["codes"] == (1, 4, "ambiguous: Delta") and said["parents"] == (1, 4, "without a name: US-2")
    assert said["repair"][:2] == (1, 4) and "snapped_vertices 2" in said["repair"][2]
    same, none = jobs.convert(rec)
    assert same.count() == 4 and none.count() == 0
