from regionloom.operators import naming
from pyspark.sql import functions as F


def test_shared_values_are_bound(spark):
    """Cleaning and splitting of a title stands once in its expression, not once a use."""
    rows = spark.createDataFrame([("Ohio in Jeju (special marker).svg", "Provinces of South Korea (old)"), (None, None), ("Ohio on the globe.svg", None)], "t string, b string")
    got = [r[0] for r in rows.select(naming.title_area(F.col("t"), F.col("b"))).collect()]
    assert got == ["Ohio, Jeju, South Korea", "", "Ohio"]
    said = rows.select(naming.title_area(F.col("t"), F.col("b")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert said.count("svgz") == 1
