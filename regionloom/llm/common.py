"""What the operators of this subpackage share: table access, shared storage, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII blanks 20 and 09-0D (hex).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own and any other session
    uses its warehouse, if that isn't a machine's own folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="regionloom-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_regionloom"
            if found.startswith(("file:", "/")):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share; the warehouse is a local one")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(docs: DataFrame) -> int:
    """Tasks for work on tables derived from `docs`: four a core, or as many as read it if that is more."""
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())


def materialize(df: DataFrame, tag: str, by: str | None = None, most: int | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again, in folders by a column of few values if given.

    Cuts the lineage and lets several consumers read one computation. The files survive a lost
    executor and go when the application ends. With `most`, at most that many tasks write one file each: they take
    the shuffle's partitions one after another, so a task holds no more, and small tables are not scattered.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = (df.coalesce(most) if most else df).write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one number, by which block and bucket counts are chosen."""
    return int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_sql(text: str) -> str:
    """SQL for DuckDB: unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT)"
