"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending id. A batch's line keys are merge-anti-joined with the
runs written so far: a key that a run holds was first seen in a smaller document, a fresh key is
kept in the smallest document of the batch. The fresh keys become a run of their own. A level with
`fanout` runs is compacted into one run of the next level, so n batches leave O(log n) runs.

Runs can outlive a call: `Runs(spark, name)` finds the runs that earlier calls with that name left, so a new
delivery of documents loses the lines that older ones have, and adds its own.

Scale. A run is a table bucketed and sorted by its 128-bit key, one file a bucket: joining it needs neither a
shuffle nor a sort of the run, and compaction reads the buckets of all runs side by side. Line
occurrences are stored by batch, so each batch reads its own only. A key that a third of all documents
share is reduced by a partial min/max before it is shuffled. Its occurrences meet a single row once, in
the last join, whose sides are both plain scans, so adaptive execution broadcasts the small one or
splits the hot partition. Texts move once, when the dropped positions are joined back.

Edge cases. Null and empty texts are one empty line. A null id counts as the largest id; ids must be integers
(or text of them). Rows with equal id are one document: they never drop each other's lines. Repeated rows
get equal results. An empty table gives an empty result. Result columns replace input columns of the same
name; other columns are kept, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, materialize, shared_dir, table, text_bytes

MIN_KEY_CHARS = 10
BUCKET_BYTES = 64 << 20  # of text whose line keys make a bucket of a run
MOST_BUCKETS = 50_000  # Spark refuses tables of more than 100,000
_LAST = (1 << 63) - 1
KEY = ["h1", "h2"]


def _row_id() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text")]


def line_occurrences(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(_id, _th, pos, h1, h2): every line whose key is long enough, with its key's 128-bit hash."""
    lines = docs.select(*_row_id()).select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    keyed = lines.select("_id", "_th", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "_id", "_th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")
    )


class Runs:
    """The sorted runs of all keys seen so far, by level: tables (h1, h2, first, last, fresh), of which fresh rows count.

    With a name the runs are the catalogue's tables of that name and stay there; without one they go with `close`.
    Runs of another number of buckets join as well, only not without a shuffle.
    """

    SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # a bucket of one file is read in its order

    def __init__(self, spark, fanout: int = 3, name: str | None = None, buckets: int = 8):
        self.spark, self.fanout, self.name, self.levels, self.spent, self.buckets = spark, fanout, name, [], [], buckets
        self.root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.prefix = f"{name}_run" if name else f"line_run_{uuid.uuid4().hex}"
        self.before = spark.conf.get(self.SORTED, "false")
        spark.conf.set(self.SORTED, "true")
        old = spark.sql(f"SHOW TABLES LIKE '{self.prefix}_*'").collect() if name else []
        for found in sorted(r["tableName"] for r in old):
            level = int(found.removeprefix(f"{self.prefix}_").split("_")[0])
            self.levels += [[] for _ in range(level + 1 - len(self.levels))]
            self.levels[level].append(found)

    def _write(self, keys: DataFrame, level: int) -> str:
        name = f"{self.prefix}_{level}_{uuid.uuid4().hex}"
        writer = keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("compression", "zstd")
        (writer if self.name else writer.option("path", f"{self.root}/{name}")).saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh")

    def add(self, keys: DataFrame) -> DataFrame:
        """Write a batch's keys (h1, h2, first, last) as a run, with fresh: whether no older run holds the key.

        Returns all of them; compacts full levels.
        """
        found = keys.repartition(self.buckets, *KEY)
        old = [x for level in self.levels for x in level]
        for i, name in enumerate(old):
            found = found.join(self._run(name).select(*KEY, F.lit(True).alias(f"old{i}")), KEY, "left")
        fresh = F.coalesce(*[F.col(f"old{i}") for i in range(len(old))], F.lit(False))
        name = self._write(found.select(*KEY, "first", "last", (~fresh).alias("fresh")), 0)
        batch, level = self.spark.table(name), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return batch
            runs = [self._run(x) for x in self.levels[level]]
            whole = runs[0]
            for other in runs[1:]:
                whole = whole.unionByName(other)
            self.spent += self.levels[level]
            self.levels[level], name = [], self._write(whole.repartition(self.buckets, *KEY), level + 1)
            level += 1

    def close(self) -> None:
        """Forget what is no longer a run, and without a name all; files stay for whoever still reads them."""
        self.spark.conf.set(self.SORTED, self.before)
        if not self.name:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
            self.spent += [x for level in self.levels for x in level]
        for name in self.spent:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dropped_positions(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = MIN_KEY_CHARS, name: str | None = None) -> DataFrame:
    """(_id, _th, pos) of every line that goes."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 10000)).first()[0]
    cuts = sorted(set(cuts or []))
    batch = sum([(F.col("_id") > c).cast("int") for c in cuts], F.lit(0))
    seen = materialize(line_occurrences(docs, min_chars).withColumn("batch", batch), "lines", "batch")
    runs, doomed = Runs(spark, fanout, name, min(MOST_BUCKETS, max(8, -(-text_bytes(docs) // BUCKET_BYTES)))), None
    try:
        for b in range(len(cuts) + 1):
            mine = seen.where(F.col("batch") == b)
            # a key that is not fresh is in an older run: all its lines go
            run = runs.add(mine.groupBy(*KEY).agg(F.min("_id").alias("first"), F.max("_id").alias("last")))
            gone = run.where("not fresh or first < last").select(*KEY, F.lit(b).alias("batch"), F.when(F.col("fresh"), F.col("first")).alias("keeper"))
            doomed = gone if doomed is None else doomed.unionByName(gone)
        doomed = materialize(doomed, "doomed-lines")
        lost = seen.join(doomed, [*KEY, "batch"]).where("keeper is null or _id > keeper")
        return materialize(lost.select("_id", "_th", "pos"), "dropped-lines")
    finally:
        runs.close()


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = MIN_KEY_CHARS, name: str | None = None) -> DataFrame:
    """`docs` plus n_lines, n_dropped and kept_text (the lines that stay, joined by line feeds).

    With `name`, lines that runs of that name hold go too, and this call's lines join them.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    gone = dropped_positions(docs, batches, fanout, min_chars, name).groupBy("_id", "_th").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*keep).alias("row"), *_row_id())
    gone_or_none = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone_or_none)
    stays = F.transform(left, lambda i: F.get("lines", i))
    out = rows.join(gone, ["_id", "_th"], "left").withColumn("lines", F.split("_text", "\n"))
    kept = F.when(F.size(gone_or_none) == 0, F.col("_text")).otherwise(F.array_join(stays, "\n"))
    new = F.size("lines").cast("long").alias("n_lines"), F.size(gone_or_none).cast("long").alias("n_dropped"), kept.alias("kept_text")
    return out.select("row", F.struct(*new).alias("new")).select("row.*", "new.*")


def op5_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, u.line, u.i
      FROM (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d) x, unnest(ls) WITH ORDINALITY AS u(line, i)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND id > min(id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (r) GROUP BY r, doc_id
"""
