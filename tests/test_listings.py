import pytest
from pyspark.sql import functions as F
from regionloom.operators import catalog, codes, spatial
from regionloom.operators import reshape as R
from regionloom.sources import layers


def lines(df):
    return [df.columns[0], *[r[0] for r in df.collect()]]


def test_text_sinks(spark):
    cw = spark.createDataFrame([("A", "B, x", None), ("A", 'C"', 0.25), ("E", "F", 1.0)], "`from` string, `to` string, weight double")
    assert lines(R.crosswalk_csv(cw)) == ["from,to,weight", 'A,"B, x",1', 'A,"C""",0.25', "E,F,1"]
    out = R.reshape(spark.createDataFrame([("A", 1.0), ("Z", 2.0)], "code string, v double"), ["v"], cw, complete=True)
    assert lines(R.conflicts_csv(out)) == ["from,targets,reason", f'A,"B, x C""","{R.NO_WEIGHTS}"', f"Z,,{R.NO_TARGET}"]


def test_codes_of_a_request(spark):
    listed = spark.createDataFrame([(" 01 ",), ("",), (None,), ("01",), ("2",)], "code string")
    assert sorted(r[0] for r in codes.data_codes(None, listed, prefix="US-").collect()) == ["US-01", "US-2"]
    assert sorted(r[0] for r in codes.data_codes(listed.withColumnRenamed("code", "k"), None, "k").collect()) == ["01", "2"]
    for both in ((None, None), (listed, listed)):
        with pytest.raises(ValueError, match="either"):
            codes.data_codes(*both)


def test_gate(spark):
    row = spark.createDataFrame([(2, 2, 1, 0.5)], "matched long, not_on_map long, without_data long, missing_share double")
    assert codes.gated(row, 0.5).first()["missing_share"] == 0.5
    with pytest.raises(Exception, match="not on the map"):
        codes.gated(row, 0.49).collect()


def test_towns(spark):
    rows = [(1, "CT", "0900100010", "7"), (2, "CT", "0900100000", "9"), (3, "NY", "3600100020", "5"), (4, "CT ", "0900300010 ", None), (5, None, None, None)]
    out = codes.town_table(spark.createDataFrame(rows, "pos int, state string, geoid string, land string"), "CT", "pos")
    assert [tuple(r) for r in out.collect()] == [("00010", "09003", 0)]


def test_claims(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.02 * (i + 1)) for i in range(8)], "a int, b int, share double")
    assert tuple(spatial.claims_text(pairs, 2).first()) == (8, "0/1 (2%), 1/2 (4%) and 6 more")
    assert tuple(spatial.claims_text(pairs.where(F.lit(False))).first()) == (0, "")


def test_releases_and_files(spark):
    rows = [("x", "b", "r2", False), ("x", "a", "r1", False), ("y", "a", "r1", True), ("z", "a", None, False)]
    out = catalog.releases(spark.createDataFrame(rows, "dataset string, code string, release string, per_region boolean"))
    assert {tuple(r) for r in out.collect()} == {("x", "r1"), ("y", "per region"), ("z", "")}
    paths = spark.createDataFrame([("in/FRA-ADM1.geojson",), ("DEU.json",), ("FRA/BEL-1.x",), (None,)], "path string")
    wanted = spark.createDataFrame([("FRA",), ("DEU",), ("FRA",)], "code string")
    assert {r[0] for r in layers.wanted_files(paths, wanted).collect()} == {"in/FRA-ADM1.geojson", "DEU.json"}
