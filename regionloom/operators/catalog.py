"""Catalogues: duplicates, publication status, usage, manifests, credits, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def set_difference(a: DataFrame, b: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of `a` whose key `b` lacks, and the other way round."""
    ka, kb = a.withColumn("_k", key), b.withColumn("_k", key)
    return ka.join(kb.select("_k"), "_k", "left_anti").drop("_k"), kb.join(ka.select("_k"), "_k", "left_anti").drop("_k")


def record_key(columns: list[str]) -> Column:
    """A key of several columns: SHA-256 of their JSON, nulls told apart from texts."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.to_json(F.struct(c)), F.lit("{}")).alias(c) for c in columns])), 256)


def publication_status(local: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """(name, status): current, older, elsewhere, changed or new.

    local: (name, hash); history: (name, hash, age), age 0 is the newest version; current: (title, hash).
    """
    past = history.groupBy("name").agg(F.min_by("hash", "age").alias("newest"))
    same = history.select("name", F.col("hash").alias("old_hash")).distinct()
    other = current.groupBy("hash").agg(F.min("title").alias("elsewhere"))
    j = local.join(past, "name", "left")
    j = j.join(same.withColumnRenamed("old_hash", "hash").withColumn("seen", F.lit(True)), ["name", "hash"], "left")
    j = j.join(other, "hash", "left")
    status = (
        F.when(F.col("newest") == F.col("hash"), "current").when(F.col("seen"), "older").when(F.col("elsewhere").isNotNull(), "elsewhere")
        .when(F.col("newest").isNotNull(), "changed").otherwise("new")
    )
    return j.select("name", status.alias("status"))


def duplicate_classes(files: DataFrame, key: str) -> DataFrame:
    """(id, representative, copies): files with equal `key`, without making all their pairs."""
    g = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return files.join(g, key).select("id", "representative", "copies")


def similar_pairs(files: DataFrame, limit: float = 0.08) -> DataFrame:
    """(a, b) of class representatives with equal (area, name_key), different hashes and close aspect ratios.

    Files (id, hash, area, name_key, ratio) of equal hash and ratio are one class. Ratios meet in
    bands of the logarithm, so that only close ones are compared.
    """
    cls = files.groupBy("area", "name_key", "hash", "ratio").agg(F.min("id").alias("id"))
    band = F.floor(F.log("ratio") / F.lit(0.0834)).cast("long")  # -ln(1 - .08), rounded up
    a = cls.withColumn("band", band)
    b = a.select("area", "name_key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
                 F.col("id").alias("id_b"), F.col("hash").alias("hash_b"), F.col("ratio").alias("ratio_b"))
    pairs = a.join(b, ["area", "name_key", "band"]).where("id < id_b and hash <> hash_b")
    close = F.abs(F.col("ratio") - F.col("ratio_b")) / F.greatest("ratio", "ratio_b") <= limit
    return pairs.where(close).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def link_lists(pairs: DataFrame) -> DataFrame:
    """(id, links): each end's partners in order."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("links"))


def usage_counts(usages: DataFrame, item: str, parts: list[str]) -> DataFrame:
    """Distinct (parts) an item."""
    return usages.groupBy(item).agg(F.countDistinct(*parts).alias("usage_count"))


def leaders(counts: DataFrame, item: str, k: int = 10) -> DataFrame:
    return counts.orderBy(F.col("usage_count").desc(), item).limit(k)


def duplicate_names(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def official_crosswalk(land: DataFrame, least: float = 0.01) -> DataFrame:
    """(from, to, weight) from land (old, new, land): shares >= least renormalised, 6 digits.

    A code whose land is zero keeps itself.
    """
    s = land.groupBy("old", "new").agg(F.sum("land").alias("land"))
    total = F.sum("land").over(W.partitionBy("old"))
    s = s.withColumn("share", F.when(total > 0, F.col("land") / total))
    kept = s.where(F.col("share") >= least)
    weights = kept.select(F.col("old").alias("from"), F.col("new").cast("string").alias("to"), F.round(F.col("share") / F.sum("share").over(W.partitionBy("old")), 6).alias("weight"))
    empty = s.where("share is null").select(F.col("old").alias("from"), F.col("old").cast("string").alias("to"), F.lit(1.0).alias("weight")).distinct()
    return weights.unionByName(empty)


def crosswalk_metadata(rows: DataFrame) -> DataFrame:
    """One row: rows and distinct changed codes."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(F.col("from") != F.col("to"), F.col("from"))).alias("changed"))


def ordered_credits(rows: DataFrame, key: list[str], credit: str, pos: str, sep: str = " · ") -> DataFrame:
    """Distinct credits in order of first use, as one text."""
    first = rows.where(F.col(credit).isNotNull()).groupBy(*key, credit).agg(F.min(pos).alias("p"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p", credit))), lambda s: s[credit])
    return first.groupBy(*key).agg(F.array_join(texts, sep).alias("credits"))


def merged_provenance(rows: DataFrame, key: str, many: str, single: str, flag: Column) -> DataFrame:
    """Distinct sorted values joined, a value if unique (else null), and whether any row has the flag."""
    return rows.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(many)), "; ").alias("joined"),
        F.when(F.min(single) == F.max(single), F.min(single)).alias("single"),
        F.bool_or(flag).alias("any_flag"),
    )


def evict(entries: DataFrame, most: int, down_to: float = 0.8, slices: int = 256) -> DataFrame:
    """Entries (id, bytes, mtime) that go, oldest first, until at most down_to * most bytes are left.

    The newest stay while their running sum fits. Sums per time slice come first, so only the slice
    in which the sum crosses is sorted, by the window of that slice alone.
    """
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.min("mtime").alias("t0"), F.max("mtime").alias("t1"))
    e = entries.join(F.broadcast(total))  # one row
    width = F.greatest((F.col("t1") - F.col("t0")).cast("double"), F.lit(1.0))
    e = e.withColumn("slice", F.least(F.lit(slices - 1), F.floor((F.col("t1") - F.col("mtime")) / width * slices)).cast("int"))
    sums = e.groupBy("slice").agg(F.sum("bytes").alias("b"))
    before = F.coalesce(F.sum("b").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # `slices` rows at most
    sums = sums.withColumn("before", before).select("slice", "before")
    inside = W.partitionBy("slice").orderBy(F.col("mtime").desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = F.col("before") + F.sum("bytes").over(inside)
    kept_limit = F.lit(down_to * most)
    gone = e.join(sums, "slice").withColumn("run", run).where((F.col("total") > most) & (F.col("run") > kept_limit))
    return gone.select("id", "bytes", "mtime")


def flags_text(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, joined by '; '."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull()), "; ")


def releases(regions: DataFrame) -> DataFrame:
    """(dataset, release) of regions (dataset, code, release, per_region): the first region's, or that each has its own."""
    first = F.coalesce(F.min_by("release", "code"), F.lit(""))
    return regions.groupBy("dataset").agg(F.when(F.bool_or("per_region"), "per region").otherwise(first).alias("release"))
