"""Holes that touch are one piece of the outside."""

from pyspark.sql import functions as F
from regionloom.operators import dissolve


def test_holes_that_touch(spark):
    """Two cells missing side by side across a corner are one hole, one at the corner of a notch is none."""
    cell = lambda x, y: [[[[x, y], [x + 1.0, y], [x + 1.0, y + 1], [x, y + 1.0], [x, y]]]]
    whole = [(float(i), float(j)) for i in range(6) for j in range(4)]
    for gaps, holes in ((((1.0, 1.0), (2.0, 2.0)), 1), (((1.0, 1.0), (3.0, 2.0)), 2), (((1.0, 1.0), (0.0, 0.0)), 0), (((1.0, 1.0), (2.0, 2.0), (4.0, 1.0)), 2)):
        rows = [(i, "a", "p", cell(*c)) for i, c in enumerate(whole) if c not in gaps]
        df = spark.createDataFrame(rows, "pos long, code string, parent string, geometry array<array<array<array<double>>>>")
        got = dissolve.grouped_references(df, F.col("code"), F.col("parent")).withColumns(dissolve.ring_counts("geometry")).first()
        assert (got["parts"], got["holes"]) == (1, holes)
