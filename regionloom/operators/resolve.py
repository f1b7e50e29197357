"""Resolving free-form names to codes, selections, composition, level checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import without_disambiguation


def norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def aliases(features: DataFrame) -> DataFrame:
    """(key, id, rank, order): what names a feature. Codes rank first, then names, then ISO-2 codes.

    features: (pos, id, name, names array, wikidata, country, area). An ISO-2 code belongs to its
    largest feature (the first of equals).
    """
    named = F.explode(F.concat(F.array("name"), F.coalesce("names", F.array().cast("array<string>")), F.array("wikidata")))
    by_name = features.select(named.alias("k"), "id", "pos").where("k is not null")
    owner = features.where("country is not null").groupBy(norm(F.col("country")).alias("key"))
    iso = owner.agg(F.max_by("id", F.struct(F.col("area"), -F.col("pos"))).alias("id"))
    rows = features.select(norm(F.col("id")).alias("key"), "id", F.lit(0).alias("rank"), "pos")
    rows = rows.unionByName(by_name.select(norm(F.col("k")).alias("key"), "id", F.lit(1).alias("rank"), "pos"))
    return rows.unionByName(iso.select("key", "id", F.lit(2).alias("rank"), F.lit(0).cast("long").alias("pos")))


def lookup_table(features: DataFrame) -> DataFrame:
    """(key, id): for every alias the feature of the best rank, the first of equals."""
    return aliases(features).groupBy("key").agg(F.min_by("id", F.struct("rank", "pos")).alias("id"))


def _tries(inputs: DataFrame) -> DataFrame:
    """(pos, input, try, key): the input itself, then what it is without '(...)'."""
    tries = F.posexplode(F.array(norm(F.col("input")), norm(without_disambiguation(F.col("input"))))).alias("try", "key")
    return inputs.select("pos", "input", tries).where("key is not null")


def resolve_regions(inputs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs (pos, input) to distinct codes in order of first mention, and the unknown inputs."""
    hits = _tries(inputs).join(lookup_table(features), "key").groupBy("pos").agg(F.min_by("id", "try").alias("id"))
    found = hits.groupBy("id").agg(F.min("pos").alias("pos"))
    return found, inputs.join(hits.select("pos"), "pos", "left_anti")


def find_features(inputs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like `resolve_regions`, but a name may be several features: then the one in the country that
    most unambiguous inputs are in, else the smallest code.
    """
    ids = features.groupBy(norm(F.col("id")).alias("key")).agg(F.min_by("id", "pos").alias("id")).withColumn("rank", F.lit(0))
    named = F.explode(F.concat(F.array("name"), F.coalesce("names", F.array().cast("array<string>")), F.array("wikidata")))
    names = features.select(named.alias("k"), "id").where("k is not null").select(norm(F.col("k")).alias("key"), "id").distinct()
    tried = _tries(inputs).join(ids.unionByName(names.withColumn("rank", F.lit(1))), "key")
    best = tried.groupBy("pos").agg(F.min(F.struct("try", "rank")).alias("best"))
    candidates = tried.join(best, "pos").where(F.struct("try", "rank") == F.col("best")).select("pos", "id").distinct()
    country = features.groupBy("id").agg(F.min_by("country", "pos").alias("country"))
    candidates = candidates.join(country, "id")
    alone = candidates.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.min("country").alias("country")).where("n = 1 and country is not null")
    votes = alone.groupBy("country").agg(F.count(F.lit(1)).alias("votes"))
    order = W.partitionBy("pos").orderBy(F.coalesce("votes", F.lit(0)).desc(), "id")
    picked = candidates.join(votes, "country", "left").withColumn("r", F.row_number().over(order)).where("r = 1")
    found = picked.groupBy("id").agg(F.min("pos").alias("pos"))
    return found, inputs.join(candidates.select("pos"), "pos", "left_anti")


def select_regions(features: DataFrame, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Features whose `column` is wanted (code), and the wanted codes that none has."""
    kept = features.join(wanted.select(F.col("code").alias(column)), column, "left_semi")
    return kept, wanted.join(features.select(F.col(column).alias("code")), "code", "left_anti")


def without_subject(context: DataFrame, subject: DataFrame, region: str | None) -> DataFrame:
    """Context features that are neither the region nor one of the subject's."""
    out = context.join(subject.select("id"), "id", "left_anti")
    return out.where(F.col("id") != region) if region is not None else out


def compose_levels(whole: DataFrame, parts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Selected features of two levels in order of the inputs (pos, code); the first level wins."""
    both = whole.withColumn("level", F.lit(0)).unionByName(parts.withColumn("level", F.lit(1)))
    hits = inputs.join(both.withColumnRenamed("id", "code"), "code")
    order = W.partitionBy("code").orderBy("level", "pos")
    return hits.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def level_clashes(subject: DataFrame) -> DataFrame:
    """Subdivisions whose country is mapped too: (id, country)."""
    countries = subject.where("class = 'country'").select(norm(F.coalesce("country", "id")).alias("key")).distinct()
    parts = subject.where("class <> 'country'").withColumn("key", norm(F.col("country")))
    return parts.join(countries, "key", "left_semi").select("id", "country")


def composite_regions(definitions: DataFrame) -> DataFrame:
    """(region, source): the first definition of each region wins."""
    return definitions.groupBy("region").agg(F.min_by("source", "pos").alias("source"))


def alias_set(features: DataFrame) -> DataFrame:
    """(id, aliases): lower-case names, sorted, each once."""
    names = F.concat(F.array("name"), F.coalesce("names", F.array().cast("array<string>")), F.array("wikidata"))
    clean = F.filter(F.transform(names, lambda n: norm(n)), lambda n: n.isNotNull())
    return features.select("id", F.array_sort(F.array_distinct(clean)).alias("aliases"))
