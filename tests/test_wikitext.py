"""Choropleth templates as recipes."""

import pytest
from regionloom.sources import wikitext as W


def test_a_list_of_countries():
    r = W.choropleth("{{Choropleth map\n| countries = Brazil; Mexico; Egypt; China; Australia\n}}")
    assert r == {"dataset": "countries", "regions": ["Brazil", "Mexico", "Egypt", "China", "Australia"], "values": {}, "params": {}, "notes": []}
    assert W.choropleth("no template") is None and W.choropleth("{{Choropleth map|color=red}}") is None and W.choropleth(None) is None
    assert W.choropleth("{{choropleth_map|countries=A;B")["regions"] == ["A", "B"]  # not closed
    assert W.choropleth("{{Other|x}} {{Template:Choropleth map|countries=A}} {{Choropleth map|countries=B}}")["regions"] == ["A"]


def test_values_colours_and_views():
    r = W.choropleth("Some text.\n{{Choropleth map\n| view = South America\n| height = 300\n| color = #00f\n| countries =\n400: BR\n300: UY; CL; PE\n#aff: SR; GY; GF\n}}\nMore.")
    assert r["regions"] == ["BR", "UY", "CL", "PE", "SR", "GY", "GF"] and r["values"]["BR"] == "400" and r["values"]["GF"] == "#aff"
    assert r["params"] == {"height": "1200", "bbox": "south-america"}
    assert any(n.startswith("color: colouring") for n in r["notes"]) and any(n.startswith("7 values") for n in r["notes"])


def test_entities_titles_and_coordinates():
    r = W.choropleth(
        "{{Choropleth map\n| view = United States\n| zoom = 2\n| latitude = 45\n| longitude = -103\n| states = California; Texas; [[New York (state)|New York]]\n"
        "| caption = Three '''big''' states<ref>A source</ref>{{Legend|#f00|Colored {{x}}}}\n| align = left\n| odd = 1\n}}"
    )
    assert r["dataset"] == "mixed" and r["regions"] == ["California", "Texas", "New York"] and r["params"]["caption"] == "Three big states"
    w, s, e, n = map(float, r["params"]["bbox"].split(";"))
    assert (w, e) == pytest.approx((-146.95, -59.05), abs=0.01) and s < 45 < n
    assert "align: page layout" in r["notes"] and "unknown parameter odd is ignored" in r["notes"]
    assert W.choropleth("{{Choropleth map|countries=A|latitude=0|longitude=0|zoom=0}}")["params"] == {"bbox": "-175.78;-89.00;175.78;89.00"}
    assert W.choropleth("{{Choropleth map|countries=A|latitude=0|longitude=0|zoom=0|width=300px}}")["params"]["frame"] == "world"


def test_other_sources_and_texts():
    r = W.choropleth("{{Choropleth map\n| source = France Departments.map\n| entities = Finistère; Nord (French department); Pyrénées-Atlantiques\n|countries=X}}")
    assert r["regions"] == ["X", "Finistère", "Nord (French department)", "Pyrénées-Atlantiques"]
    assert r["notes"] == ["both countries and entities are given: both are used", "source France Departments.map: other boundaries are used"]
    assert [W.without_disambiguation(t) for t in ("New York (state)", "Nord (French department)", "France", "(x)")] == ["New York", "Nord", None, None]
    assert W.is_value("40%") and W.is_value("1,000.5") and not W.is_value("Note") and not W.is_value("#12345")
    assert W.plain("a <ref name=x/>b<br/> ''c'' [[d|e]] [[f]]") == "a b c e f"


def test_recipes(spark):
    df = spark.createDataFrame([(1, "{{Choropleth map|countries=5: A; B}}"), (2, "none"), (3, None)], "k long, t string")
    assert [(r["k"], r["regions"], r["values"]) for r in W.choropleth_recipes(df, "k", "t").collect()] == [(1, ["A", "B"], {"A": "5", "B": "5"})]
