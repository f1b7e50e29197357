import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from regionloom.operators import codes, graph, layout, overlay, projection, resolve, rings, snap, spatial, units
from regionloom.operators import reshape as R
from regionloom.sources import documents, gpkg, markup, tables

CW = "`from` string, `to` string, weight double"


def crosswalk(spark):
    rows = [("OLD-A", "NEW-A", None), ("OLD-B", "NEW-BC", None), ("OLD-C", "NEW-BC", 1.0), ("OLD-D", "NEW-D1", 0.25), ("OLD-D", "NEW-D2", 0.75), ("OLD-E", "NEW-E1", None), ("OLD-E", "NEW-E2", None)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CW + ", pos int")


@pytest.mark.parametrize("complete", [True, False])
def test_reshape_main_case(spark, complete):
    data = [("OLD-A", 10.0), ("OLD-B", 1.0), ("OLD-C", 2.0), ("OLD-D", 100.0), ("OLD-E", 5.0), ("OLD-F", 7.0)]
    out = R.reshape(spark.createDataFrame(data, "code string, v double"), ["v"], crosswalk(spark), complete)
    want = {"NEW-A": 10.0, "NEW-BC": 3.0, "NEW-D1": 25.0, "NEW-D2": 75.0} | ({} if complete else {"OLD-F": 7.0})
    assert {r["code"]: r["v"] for r in out.rows.collect()} == want
    reasons = {r["from"]: (r["targets"], r["reason"]) for r in out.conflicts.collect()}
    assert reasons["OLD-E"] == ("NEW-E1 NEW-E2", R.NO_WEIGHTS)
    assert reasons.get("OLD-F") == (("", R.NO_TARGET) if complete else None)
    assert tuple(out.summary.first()) == ((3, 1, 2) if complete else (4, 1, 1))


def test_reshape_odd_weights(spark):
    cw = spark.createDataFrame([("A", "X", 0.5), ("B", "Y", 0.9995), ("C", "Z", None), ("C", "Z", None), ("D", "P", 0.4), ("D", "Q", 0.5), ("E", "T", float("nan"))], CW)
    data = spark.createDataFrame([(c, 10.0) for c in "ABBCDE"], "code string, v double")
    out = R.reshape(data, ["v"], cw)
    assert {r["code"]: round(r["v"], 6) for r in out.rows.collect()} == {"Y": 19.99}
    assert tuple(out.summary.first()) == (0, 2, 4)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABCD"), st.integers(-50, 50)), min_size=1, max_size=12))
def test_reshape_keeps_mass(spark, data):
    cw = spark.createDataFrame([("A", "X", 0.5), ("A", "Y", 0.5), ("B", "X", None), ("C", "Z", 1.0)], CW)
    out = R.reshape(spark.createDataFrame([(c, float(v)) for c, v in data], "code string, v double"), ["v"], cw)
    assert sum(r["v"] for r in out.rows.collect()) == pytest.approx(sum(v for _, v in data))


def test_reshape_table_and_csv(spark):
    t = spark.createDataFrame([("02261", "100", "VC"), ("02020", "5", "Anc")], "fips string, pop string, name string")
    cw = spark.createDataFrame([("02261", "02063", 0.4), ("02261", "02066", 0.6)], CW)
    assert R.numeric_columns(t, ["fips"]) == ["pop"]
    out = R.reshape_table(t, "fips", None, cw)
    text = R.reshaped_csv(out, "fips", ["pop"])
    assert [text.columns[0], *[r[0] for r in text.collect()]] == ["fips,pop", "02020,5", "02063,40", "02066,60"]
    with pytest.raises(Exception, match="not a number"):
        R.reshape_table(t, "fips", ["name"], cw).rows.collect()


def test_match(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "code string")
    unit = spark.createDataFrame([("36005", "NYC"), ("36047", "NYC")], "code string, unit string")
    found = codes.match_codes(one(["02261", "02020", "36005", "36047"]), unit, one(["02063", "02066", "02020", "NYC"]))
    got = {k: sorted(r[0] for r in df.collect()) for k, df in found.items()}
    assert got == {"matched": ["02020", "NYC"], "not_on_map": ["02063", "02066"], "without_data": ["02261"]}
    assert codes.match_summary(found).first()["missing_share"] == 0.5


def test_lookup_and_hints(spark):
    t = spark.createDataFrame([("Lancaster", "31109"), ("Lancaster", "42071"), ("Ada", "16001"), ("Ada", "16001")], "name string, fips string")
    clear, ambiguous = codes.lookup(t, "name", "fips")
    assert [tuple(r) for r in clear.collect()] == [("Ada", "16001")] and [r[0] for r in ambiguous.collect()] == ["Lancaster"]
    cw = spark.createDataFrame([("c", "XA-00", "XA-01"), ("c", "XA-02", "XA-09")], "crosswalk string, `from` string, `to` string")
    missing = spark.createDataFrame([("XA-00",), ("XA-09",), ("ZZ",)], "code string")
    got = {r["direction"]: r["codes"] for r in codes.crosswalk_hints(missing, cw).collect()}
    assert got == {"old-data": ["XA-00"], "new-data": ["XA-09"]}


def unit_case(spark):
    rows = [("B0", "NYC"), ("B1", "NYC"), ("B2", "KC"), ("B3", "KC"), ("B3", "Jackson"), ("C", "KC"), ("Z9", "NYC")]
    return spark.createDataFrame([(r, u, None, i) for i, (r, u) in enumerate(rows)], "region string, unit string, name string, pos int")


def test_units(spark):
    f = spark.createDataFrame([(x,) for x in ("B0", "B1", "B2", "B3", "B4", "C")], "id string")
    got = sorted(tuple(r) for r in units.unit_report(f, unit_case(spark)).collect())
    assert got == [("overlapping", "B3"), ("unassigned", "B4"), ("unknown", "Z9")]
    assert {r["region"]: r["units"] for r in units.assignments(unit_case(spark)).collect()}["B3"] == ["KC", "Jackson"]
    names = {n: i for i, n in enumerate(("B0", "B1", "B2", "B3", "B4", "C"))}
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    members = spark.createDataFrame([(names[r], u) for r, u in (("B0", "NYC"), ("B1", "NYC"), ("B2", "KC"), ("B3", "KC"), ("C", "KC"))], "region long, unit string")
    assert [tuple(r) for r in units.split_units(edges, members, graph.components).collect()] == [("KC", 2)]


def test_dissolve(spark):
    f = spark.createDataFrame([(f"B{i}", f"b{i}", "x", "NY", None, "us", [i]) for i in range(5)] + [("C", "c", "x", None, None, "us", [9])],
                              "id string, name string, class string, parent string, parent_name string, country string, geometry array<int>")
    rows = spark.createDataFrame([(f"B{i}", "NYC", "NYC city", i) for i in range(5)], "region string, unit string, name string, pos int")
    got = {r["id"]: r for r in units.dissolve(f, rows).collect()}
    assert set(got) == {"NYC", "C"} and got["NYC"]["name"] == "NYC city" and got["NYC"]["geometry"] == [0, 1, 2, 3, 4] and got["NYC"]["parent"] == "NY"


def square(x, y, w, h):
    return [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]]


def test_area_kernel():
    area = lambda *shapes, union=False: overlay.areas([list(shapes)], union)[0]
    a, b = square(0, 0, 2, 2), square(1, 1, 2, 2)
    assert area(a, b) == pytest.approx(1) and area(a, b, union=True) == pytest.approx(7)
    assert area(a, square(5, 5, 1, 1)) == 0
    hole = [[square(0, 0, 4, 4)[0][0], square(1, 1, 2, 2)[0][0]]]
    assert area(hole) == pytest.approx(12) and area(hole, square(1, 1, 1, 1)) == pytest.approx(0)
    tri = [[[[0, 0], [4, 0], [0, 4], [0, 0]]]]
    assert area(tri, square(1, 1, 9, 9)) == pytest.approx(2)
    assert area([]) == 0


def boxes(spark, rows):
    return spark.createDataFrame([(i, float(a), 0.0, float(b), 1.0) for i, a, b in rows], "id string, x0 double, y0 double, x1 double, y1 double")


def test_overlap_crosswalk(spark):
    old, new = boxes(spark, [("OLD", 0, 4)]), boxes(spark, [("N1", 0, 1), ("N2", 1, 4), ("N3", 3.999, 10)])
    got = spatial.overlap_crosswalk(spatial.box_pairs(old, new, 2.0), spatial.box_overlap(), spatial.box_area(), 0.01)
    assert {r["to"]: r["weight"] for r in got.collect()} == {"N1": 0.25, "N2": 0.75}


def test_snapping_and_near_misses(spark):
    rows = [(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 1.0, 1.0), (1, 0, 1.001, 0.001), (1, 1, 2.0, 0.0), (1, 2, 1.002, 0.5)]
    f = spark.createDataFrame([("l", o, 0, 0, p, x, y) for o, p, x, y in rows], "layer string, owner long, part int, ring int, pos long, x double, y double")
    got = {(r["owner"], r["pos"]): (round(r["x"], 6), round(r["y"], 6)) for r in snap.snap_features(f, 0.01).collect()}
    assert got[1, 0] == (1.0, 0.0) and got[1, 2] == (1.0, 0.5) and got[1, 1] == (2.0, 0.0)


def test_components_and_depth(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("r", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    assert {r["category"]: r["level"] for r in graph.category_tree(links, "r").collect()} == {"r": 0, "a": 1, "b": 1, "c": 2}


def test_covering_arc(spark):
    p = spark.createDataFrame([("f", 170.0), ("f", -170.0), ("f", 179.0), ("g", 5.0), ("h", -180.0), ("h", 0.0)], "k string, lon double")
    got = {r["k"]: (r["start"], r["length"]) for r in rings.covering_arc(p, "k", "lon").collect()}
    assert got == {"f": (170.0, 20.0), "g": (5.0, 0.0), "h": (-180.0, 180.0)}


def test_projections(spark):
    df = spark.createDataFrame([(10.0, 50.0), (11.0, 50.0), (10.0, 51.0)], "lon double, lat double")
    for x, y in (projection.laea(F.col("lon"), F.col("lat"), 10, 50), projection.albers(F.col("lon"), F.col("lat"), 10, 50, 40, 60), projection.lambert_conic(F.col("lon"), F.col("lat"), 10, 50, 40, 60)):
        a, b, c = df.select(x.alias("x"), y.alias("y")).collect()
        assert abs(a["x"]) < 1e-6 and abs(a["y"]) < 1e-6 and b["x"] > 0 and c["y"] > 0
    assert projection.choose_projection(None, 0) == "equal_earth" and projection.choose_projection(50, 40) == "albers" and projection.choose_projection(10, 40) == "laea"
    assert projection.one_sixth_parallels(40, 52) == (42, 50)


def test_simplify_and_poles():
    p = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], float)
    assert rings.simplify(p, 0.1).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    x, y, d = layout.pole([(0, 0), (4, 0), (4, 4), (0, 4)], 0.01)
    assert (x, y) == (2, 2) and d == pytest.approx(2)


def test_polygon_validity(spark):
    v = [("bow", 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])]
    v += [("ok", 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)])]
    df = spark.createDataFrame(v, "feature string, part int, ring int, pos int, x double, y double")
    assert [tuple(r) for r in rings.polygon_problem(rings.edges(df), 0.5).collect()] == [("bow", 0, "edges cross")]


def test_resolve(spark):
    f = spark.createDataFrame([(0, "FR-59", "Nord", None, None, "FR", 1.0), (1, "HT-ND", "Nord", None, None, "HT", 1.0), (2, "FR-75", "Paris", ["Parigi"], "Q90", "FR", 1.0)],
                              "pos long, id string, name string, names array<string>, wikidata string, country string, area double")
    inputs = spark.createDataFrame([(0, "Nord (French department)"), (1, "parigi"), (2, "Nowhere")], "pos long, input string")
    found, unknown = resolve.find_features(inputs, f)
    assert sorted(r["id"] for r in found.collect()) == ["FR-59", "FR-75"] and [r["input"] for r in unknown.collect()] == ["Nowhere"]


def test_texts():
    assert tables.sniff("a,b") == "," and tables.sniff("a") == ";" and tables.sniff("a|b,c") == "|"
    assert markup.parse_recipe("# x\nkey,value\ntitle,My map\nregions,FR;DE\n") == {"regions": ["FR", "DE"], "title": "My map"}
    r = markup.parse_recipe("region\nFR\nDE\n")
    assert r == {"regions": ["FR", "DE"]} and markup.parse_recipe(markup.recipe_text({"title": "A, b", "regions": ["FR"]})) == {"title": "A, b", "regions": ["FR"]}
    assert markup.template("x {{Choropleth|a=1|b={{c|d}}|[[e|f]]}} y", "choropleth") == {"a": "1", "b": "{{c|d}}", "3": "[[e|f]]"}
    assert documents.parse_box("170,-10,-170,10") == (170, -10, -170, 10)
    with pytest.raises(ValueError):
        documents.check_options({"width": 5})


def test_read_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿code,name\n25007,"Dukes and Nantucket, MA"\n\n9,"Say ""hi"""\n', encoding="utf-8")
    got = [tuple(r) for r in tables.read_table(spark, str(tmp_path / "t.csv")).collect()]
    assert got == [("25007", "Dukes and Nantucket, MA"), ("9", 'Say "hi"')]


def test_geopackage_bytes():
    data = gpkg.file_bytes([({"a b": 1, "A_B": 2, "x": True}, square(0, 0, 1, 1)), ({"x": None}, square(5, 0, 1, 1))], "t", ["x"])
    rows = list(gpkg.select_rows(data, None, None, None, (4, 0, 9, 9)))
    assert len(rows) == 1 and rows[0][0] == 2
    assert [{k: v for k, v in r[1].items() if k != "fid"} for r in gpkg.select_rows(data, "t", None, None, None)] == [{"a_b": "1", "x": "1"}, {"a_b": None, "x": None}]
    assert math.isclose(rows[0][2][0][0][1][0], 6.0)
