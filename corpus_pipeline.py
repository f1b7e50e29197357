"""The corpus pipeline over `documents`: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept and returns a
DataFrame, which `run` writes as Parquet and reads again as the next stage's documents. All stages
but the last return the columns of documents.

Nulls, empty and very long texts, ties, repeated rows and empty tables are handled as each operator's
module states; a stage adds no columns to what it passes on, so clashing names cannot occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionloom.llm import bpe, lines, mixing, quality, similar
from regionloom.llm.common import materialize, spread, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ratio = quality.fit_log_ratio(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, ratio).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller document holds; n_chars follows the text."""
    out = lines.dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies (5-word Jaccard of 0.8 or more): the smallest.

    Of rows with equal id and text one stays, the first by its other columns; null ids count as the largest.
    The result has at most as many files as `spread` says, however many partitions a shuffle has.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64("text").alias("_th")]
    found = similar.similar_texts(docs.select(*key, "text"))
    keepers = found.groupBy("component").agg(F.min(F.struct("_id", "_th")).alias("k")).select("k.*")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key).join(keepers, ["_id", "_th"], "left_semi")
    return rows.groupBy("_id", "_th").agg(F.min("row").alias("row")).select("row.*").coalesce(spread(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    return mixing.repeat_rows(mixing.mix_sources(docs), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the text's token ids, their number and the digests of ids and decoded bytes."""
    import public_tokenizers

    columns = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.tokenize(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]
#: SQL cannot express fingerprints by XXH64 or BPE; tests/llm/test_pipeline.py has a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
