"""Matching codes, hints from crosswalks, lookups and code assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import not_blank


def table_codes(table: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Distinct prefixed codes of a column."""
    return table.where(not_blank(F.col(column)).isNotNull()).select(F.concat(F.lit(prefix), not_blank(F.col(column))).alias("code")).distinct()


def match_codes(map_codes: DataFrame, map_units: DataFrame, data_codes: DataFrame) -> dict[str, DataFrame]:
    """Codes of a table against those of a map: matched, not_on_map, without_data.

    map_codes and data_codes: (code); map_units: (code, unit). A data code matches a region or a unit;
    a region has data if its code or one of its units does.
    """
    regions, data = map_codes.select("code").distinct(), data_codes.select("code").distinct()
    known = regions.unionByName(map_units.select(F.col("unit").alias("code"))).distinct()
    covered = map_units.join(data.select(F.col("code").alias("unit")), "unit", "left_semi").select("code")
    return {
        "matched": data.join(known, "code", "left_semi"),
        "not_on_map": data.join(known, "code", "left_anti"),
        "without_data": regions.join(data, "code", "left_anti").join(covered, "code", "left_anti"),
    }


def match_summary(found: dict[str, DataFrame]) -> DataFrame:
    """One row: the three counts and the share of data codes that are missing."""
    rows = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    n = rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("matched", "not_on_map", "without_data")])
    return n.withColumn("missing_share", F.coalesce(F.try_divide("not_on_map", F.col("matched") + F.col("not_on_map")), F.lit(0.0)))


def crosswalk_hints(missing: DataFrame, crosswalks: DataFrame, prefix: str = "") -> DataFrame:
    """Which crosswalks explain missing codes: (crosswalk, direction, codes).

    Codes only on the 'from' side of a crosswalk (crosswalk, from, to) are old-data, only on the 'to'
    side new-data.
    """
    bare = F.when(F.col("code").startswith(prefix), F.substring(F.col("code"), len(prefix) + 1, 1 << 20)).otherwise(F.col("code"))
    want = missing.select(bare.alias("code")).distinct()
    sides = crosswalks.select("crosswalk", F.explode(F.array(
        F.struct(F.col("from").alias("code"), F.lit(1).alias("old"), F.lit(0).alias("new")),
        F.struct(F.col("to").alias("code"), F.lit(0).alias("old"), F.lit(1).alias("new")),
    )).alias("s")).select("crosswalk", "s.*")
    seen = sides.join(want, "code", "left_semi").groupBy("crosswalk", "code").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    one_sided = seen.where(F.col("old") != F.col("new"))
    direction = F.when(F.col("old") == 1, "old-data").otherwise("new-data")
    codes = F.array_sort(F.collect_list(F.concat(F.lit(prefix), F.col("code"))))
    return one_sided.groupBy("crosswalk", direction.alias("direction")).agg(codes.alias("codes"))


def lookup(table: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(key, value) for keys with one distinct value, and the ambiguous keys."""
    rows = table.select(not_blank(F.col(key)).alias("key"), not_blank(F.col(value)).alias("value")).where("key is not null and value is not null")
    seen = rows.groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    clear = seen.where("value = other").select("key", "value")
    return clear, seen.where("value <> other").select("key")


def assign_codes(records: DataFrame, match: Column, clear: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """`records` plus code (and parent) by lookup on `match`, and whether it matched."""
    out = records.withColumn("_key", match).join(clear.select(F.col("key").alias("_key"), F.col("value").alias("code")), "_key", "left")
    if parents is not None:
        out = out.join(parents.select(F.col("key").alias("_key"), F.col("value").alias("parent")), "_key", "left")
    return out.withColumn("matched", F.col("code").isNotNull()).drop("_key")


def parent_names(records: DataFrame, parent: str, names: DataFrame, prefix: str) -> DataFrame:
    """`records` plus parent_name, found by the bare or the prefixed key (on a clash the later key wins)."""
    both = names.select(F.col("key"), F.col("key").alias("k"), "value").unionByName(
        names.select(F.concat(F.lit(prefix), F.col("key")).alias("key"), F.col("key").alias("k"), "value")
    )
    best = both.groupBy("key").agg(F.max_by("value", "k").alias("parent_name"))
    return records.join(best.withColumnRenamed("key", parent), parent, "left")


def unmatched_parents(records: DataFrame, parent: str, pos: str) -> DataFrame:
    """Parents without a name, by first appearance."""
    return records.where(F.col("parent_name").isNull() & F.col(parent).isNotNull()).groupBy(parent).agg(F.min(pos).alias("first_pos"))


def country_alpha2(code: Column, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """`records` plus alpha2: two letters pass through, three are looked up in `pairs` (alpha3, alpha2)."""
    out = records.withColumn("_c", F.upper(F.trim(code)))
    out = out.join(pairs.select(F.col("alpha3").alias("_c"), F.col("alpha2").alias("_a")), "_c", "left")
    return out.withColumn("alpha2", F.when(F.col("_c").rlike("^[A-Z]{2}$"), F.col("_c")).otherwise(F.col("_a"))).drop("_c", "_a")


def split_count(rows: DataFrame, order: str) -> DataFrame:
    """How many rows have the same 'from' as the row before them in order; positions may have gaps.

    Rows are dealt into ranges of the position, each range counts inside itself and names its first and last
    row, and one row a range is left to compare where ranges meet. So the table is never sorted in one task.
    """
    part = F.spark_partition_id().alias("part")
    dealt = rows.select(F.col(order).alias("at"), "from").repartitionByRange("at").select("*", part)
    inside = W.partitionBy("part").orderBy("at")
    same = dealt.withColumn("same", (F.col("from") == F.lag("from").over(inside)).cast("long"))
    ends = same.groupBy("part").agg(
        F.sum("same").alias("n"), F.min("at").alias("at"), F.min_by("from", "at").alias("first"), F.max_by("from", "at").alias("last")
    )
    along = W.partitionBy(F.lit(0)).orderBy("at")  # one row a range
    met = ends.withColumn("met", (F.col("first") == F.lag("last").over(along)).cast("long"))
    return met.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("met"), F.lit(0))).alias("splits"))


def listed_codes(codes: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct prefixed codes of a list (code), trimmed; blank ones go."""
    return table_codes(codes, "code", prefix)


def data_codes(table: DataFrame | None, codes: DataFrame | None, column: str = "code", prefix: str = "") -> DataFrame:
    """The codes of a request, which gives either a table or a list of codes."""
    if (table is None) == (codes is None):
        raise ValueError("give either a table or codes")
    return table_codes(table, column, prefix) if codes is None else listed_codes(codes, prefix)


def gated(summary: DataFrame, most: float) -> DataFrame:
    """The row of `match_summary`; fails where a larger share than `most` is missing."""
    share = F.col("missing_share")
    message = F.concat(F.lit("share of codes that are not on the map: "), share.cast("string"), F.lit(f", allowed: {most}"))
    return summary.withColumn("missing_share", F.when(share > most, F.raise_error(message).cast("double")).otherwise(share))


def town_table(places: DataFrame, state: str, order: str) -> DataFrame:
    """(town, county, land) of a state's county subdivisions (state, geoid, land); 00000 is no town, of equal towns the last stays.

    A geoid is five digits of the county and five of the town; no land is 0.
    """
    geoid = F.trim("geoid")
    rows = places.where((F.trim("state") == state) & ~geoid.endswith("00000"))
    land = F.coalesce(F.expr("try_cast(trim(land) AS long)"), F.lit(0).cast("long"))
    row = F.struct(F.substring(geoid, 1, 5).alias("county"), land.alias("land"))
    return rows.groupBy(F.substring(geoid, 6, 32).alias("town")).agg(F.max_by(row, order).alias("r")).select("town", "r.*")
