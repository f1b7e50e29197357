"""Depths without a cap, cycles, and positions with gaps."""

from regionloom.functions import scalars
from regionloom.operators import codes, graph, naming, rings


def test_chain_longer_than_any_cap_and_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(70)]
    links = spark.createDataFrame([*chain, ("n0", "n70"), ("n3", "n1"), ("x", "n2")], "parent string, child string")
    levels = {r["category"]: r["level"] for r in graph.category_tree(links, "n0").collect()}
    assert len(levels) == 71 and levels["n70"] == 1 and levels["n69"] == 69
    straight = spark.createDataFrame([*[(f"n{i}", f"n{i + 1}") for i in range(12)], ("n0", "n12"), ("y", "n5")], "parent string, child string")
    assert {r["category"]: r["depth"] for r in graph.longest_depth(straight, "n0").collect()} == {f"n{i}": i for i in range(13)}
    loop = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("r", "d")], "parent string, child string")
    assert {r["category"]: r["depth"] for r in graph.longest_depth(loop, "r").collect()} == {"r": 0, "d": 1, "a": None, "b": None, "c": None}
    members = {r["category"]: (r["level"], r["parents"], r["children"]) for r in graph.category_members(loop, graph.category_tree(loop, "r")).collect()}
    assert members["b"] == (2, ["a"], ["a", "c"]) and members["r"] == (0, [], ["a", "d"])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(300, 301)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(151)) and got[301] == 300


def test_split_count_with_gaps(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 9), ("b", 20), ("b", 21), ("a", 40)], "from string, pos int")
    for n in (1, 3):
        assert codes.split_count(rows.repartition(n), "pos").first()["splits"] == 3
    assert codes.split_count(rows.limit(0), "pos").first()["splits"] == 0


def test_rings_with_non_finite_vertices_go(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = [("f", 0, 0, k, x, y) for k, (x, y) in enumerate(square)] + [("f", 1, 0, k, x if k else float("nan"), y) for k, (x, y) in enumerate(square)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip([*rings.RING, "pos", "x", "y"], ["string", "int", "int", "int", "double", "double"])))
    assert {r[rings.RING[1]] for r in rings.clean_rings(df).collect()} == {0}


def test_areas(spark):
    rows = [("Category:Blank maps of Lower Saxony (old)", "Blank map of Peru; other"), ("Maps by country", "map - Chad"), ("Flags", "It is in Africa"), ("Map showing Mali.", "None")]
    df = spark.createDataFrame(rows, "c string, t string")
    got = df.select(naming.area_of_category(df.c).alias("a"), naming.described_area(df.t).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Lower Saxony", "Peru"), ("", "Chad"), ("", "Africa"), ("Mali", "")]


def test_areas_of_several_words(spark):
    rows = ["A look at North America in 1900", "Trade with South Korea", "Southern Koreatown", "afro-eurasia", None, ""]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(naming.described_area(df.t)).collect()] == ["North America", "South Korea", "", "Afro-Eurasia", "", ""]


def test_unique_ids_meet_ids_that_are_there(spark):
    raw = ["a", "a", "a-2", "a", "a-2", "a-2-2", "1", "é é", None, "b-3", "b", "b", "b"]
    df = spark.createDataFrame(list(enumerate(raw)), "k long, r string")
    got = {r["k"]: r["xml_id"] for r in naming.unique_ids(df, "r", "k").collect()}
    used, want = set(), []
    for x in raw:
        x = "".join(c if c.isalnum() or c in "_.-" else "_" for c in x or "")
        x = x if x[:1].isalpha() or x[:1] == "_" else "id-" + x
        n, y = 2, x
        while y in used:
            y, n = f"{x}-{n}", n + 1
        used.add(y)
        want.append(y)
    assert [got[k] for k in range(len(raw))] == want and got[1] == "a-2" and got[2] == "a-2-2"
    assert naming.unique_ids(df.limit(0), "r", "k").count() == 0


def test_cache_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b")], "x string, y string, z string")
    keys = {r[0] for r in df.select(scalars.cache_key([df.x, df.y, df.z])).collect()} | {r[0] for r in df.select(scalars.cache_key([df.x, df.z])).collect()}
    assert len(keys) == 5
