import json

import pytest
from regionloom.sources import gpkg, layers

TOML = """
[[dataset]]
id = "world"
file = "world.gpkg"
filter_column = "iso"
[[dataset]]
id = "parts"
pattern = "parts/{region}.geojson"
[[dataset]]
id = "both"
parts = ["world", "parts"]
"""


def square(x):
    return [[[[x, 0.0], [x + 1.0, 0.0], [x + 1.0, 1.0], [x, 1.0], [x, 0.0]]]]


def test_layers_of_both_kinds_agree(spark, tmp_path):
    props = [{"iso": "FRA", "uid": "1", "code": "FR-A", "name": "A"}, {"iso": "FRA", "uid": "u2", "code": "NA", "name": "B"}, {"iso": "BEL", "uid": "3", "code": "BE", "name": "C"}]
    shapes = [square(0.0), square(10.0), square(20.0)]
    features = [{"type": "Feature", "properties": p, "geometry": {"type": "MultiPolygon", "coordinates": g}} for p, g in zip(props, shapes)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "a.gpkg").write_bytes(gpkg.file_bytes(list(zip(props, shapes)), "t"))
    q = layers.LayerQuery(id_columns=("code", "uid"), filter_column="iso")
    for ext in ("geojson", "gpkg"):
        path = str(tmp_path / f"a.{ext}")
        got = layers.read_layer(spark, path, q, "FRA")
        assert sorted((r["id"], r["name"], r["x0"]) for r in got.collect()) == [("FR-A", "A", 0.0), ("u2", "B", 10.0)]
        assert [r["id"] for r in layers.read_layer(spark, path, q, "FRA", (9.0, 0.0, 12.0, 1.0)).collect()] == ["u2"]
    with pytest.raises(ValueError):
        layers.kind("a.shp")


def test_catalogue(spark, tmp_path):
    found = layers.read_catalogue(TOML)
    assert found["both"].parts == ("world", "parts")
    with pytest.raises(ValueError):
        layers.read_catalogue(TOML.replace('"parts"]', '"nothing"]'))
    files = spark.createDataFrame([("x/parts/FR.geojson",), ("x/other.json",)], "path string")
    assert [tuple(r) for r in layers.regions_of_files(files, "parts/{region}.geojson").collect()] == [("FR", "x/parts/FR.geojson")]
    assert layers.worldview_path("d/w.geojson", "FRA", ["FRA"]) == "d/w_fra.geojson"
    (tmp_path / "cw.csv").write_text("from,to,weight\nXA-00,XA-01,1\nXA-02,XA-09,\n")
    assert sorted(map(tuple, layers.load_crosswalks(spark, str(tmp_path)).collect()), key=str) == [("cw", "XA-00", "XA-01", 1.0), ("cw", "XA-02", "XA-09", None)]
