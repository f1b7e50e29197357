"""Mixing sources to target weights: Efraimidis-Spirakis sampling over token budgets.

Every source gets a token target. Complete epochs of the source come first; the fraction left is
a weighted sample without replacement: each document draws the exponential key -ln(u) / weight
(u from a hash of its id and text), documents are taken in key order while their sizes' prefix sum stays
within the budget, and the document that crosses it is taken if that ends nearer to it.

Scale. A source may hold a third of all rows, so no source is sorted as a whole. Keys are fixed-point
numbers; sums of sizes by their leading bits (a partial aggregate of at most 4,096 rows a source) give the
one value of these bits at which a source's budget runs out, and three times only the rows there are
looked at further, by 12 more bits. What is left, one of 2^36 slices of the keys, is grouped by document
and sorted. What results is one cut-off per source, which every row compares itself with: no row-level
shuffle, no text moved.

Edge cases. A null source is a source of its own, last in order. A null id draws as the text
'null'. Null or empty texts have size 0 and are taken as often as their source's epochs say. Rows that
repeat (same id and text) have one key; if the cut-off falls among them, as many as fit are taken, those
first by a hash of all columns. Ties of different documents go by id, then size. An empty table gives an
empty result. Result columns replace input columns of the same name; other columns are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

SYMBOLS = "#*$%&|<>"
RESULT = ("size", "source_size", "target", "copies", "taken")
KEY_BITS = 60  # of the key in fixed point, 10 of them before the point
STEP_BITS = 12
LEVELS = 3
CHUNK = 1 << 16


def token_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less as symbols take a larger share; above 0 always."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("double")
    clean = F.coalesce(F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("double")
    return (n + 1.0) / (n + 1.0 + 20.0 * (n - clean))


def draw_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of md5(seed:id:md5(text))."""
    parts = F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))
    bits = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, source_weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """Targets from (source_key, source_size): weights by source order, water-filled below the caps.

    With sources ordered by cap / weight the capped ones form a prefix, so a running sum of caps and
    weights gives each source the level it would get if all before it were capped. The table has one
    row per source, which bounds the only global sort here.
    """
    weights = F.array(*[F.lit(float(w)) for w in source_weights])
    # 'n' (null) sorts before 's...' as text, so the flag comes first
    order = W.orderBy(F.col("source_key") == "n", "source_key")
    t = sizes.withColumn("rank", F.row_number().over(order) - 1)
    t = t.withColumn("w", F.element_at(weights, (F.col("rank") % len(source_weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    everything = W.partitionBy(F.lit(0))
    filling = W.partitionBy(F.lit(0)).orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("cap", cap).withColumn("ratio", cap / F.col("w"))
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(filling), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filling), F.lit(0.0))),
    )
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.col("w") * F.max("level").over(everything))
    t = t.withColumn("target", F.least("cap", target))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    t = t.withColumn("epochs", epochs.cast("int"))
    return t.select(
        "source_key", "source_size", "target", "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
    )


def _keyed(docs: DataFrame, keep: list[str], seed: str) -> DataFrame:
    """row (all columns to keep), text, id, source_key, size, key, and bits, the key in fixed point (60 bits)."""
    key = draw_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")), seed)
    rows = docs.select(
        F.struct(*keep).alias("row"), "text", F.col("doc_id").alias("id"), token_count(F.col("text")).alias("size"), key.alias("key"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"),
    )
    most = (1 << KEY_BITS) - 1
    return rows.withColumn("bits", F.least(F.lit(float(most)), F.col("key") * F.lit(float(1 << KEY_BITS - 10))).cast("long"))


def _crossing(rows: DataFrame, now: DataFrame, shift: int) -> DataFrame:
    """`now` (source_key, rest, before, head) with head, the leading bits at the cut-off, made longer: down to `shift`."""
    running = W.partitionBy("source_key").orderBy("head").rowsBetween(W.unboundedPreceding, -1)
    here = rows.join(now, "source_key").where(F.shiftright("bits", shift + STEP_BITS) == F.col("head"))
    sums = here.groupBy("source_key", F.shiftright("bits", shift).alias("head")).agg(F.sum("size").alias("n"))
    sums = sums.withColumn("more", F.coalesce(F.sum("n").over(running), F.lit(0))).join(now.drop("head"), "source_key")
    start = F.col("before") + F.col("more")
    crossed = sums.where((start < F.col("rest")) & (start + F.col("n") >= F.col("rest")))
    return crossed.select("source_key", "rest", start.alias("before"), "head")


def _cutoffs(rows: DataFrame, source_weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """Per source: targets, epochs, the last (key, id, size) that the fraction takes, how many rows have it and how many of them go in."""
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, source_weights, share, max_epochs), "mix-targets")
    now = targets.where("rest > 0").select("source_key", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("head"))
    for level in range(1, LEVELS + 1):
        now = materialize(_crossing(rows, now, KEY_BITS - STEP_BITS * level), "mix-cut")
    here = rows.join(now, "source_key").where(F.shiftright("bits", KEY_BITS - STEP_BITS * LEVELS) == F.col("head"))
    equal = here.groupBy("source_key", "rest", "before", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    inside = W.partitionBy("source_key").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))
    fit = F.floor((F.col("rest") - F.col("start")) / F.col("size") + 0.5)  # 2 * (start + fit * size) - size <= 2 * rest
    fit = F.when(F.col("size") == 0, F.when(F.col("start") <= F.col("rest"), F.col("n")).otherwise(0)).otherwise(F.least("n", fit))
    last = equal.withColumn("start", start).withColumn("fit", fit.cast("long")).where("fit > 0").groupBy("source_key")
    last = last.agg(F.max(F.struct("key", "id", "size", "n", "fit")).alias("last"))
    edge = now.select("source_key", F.col("head").alias("edge"))
    return materialize(targets.join(edge, "source_key", "left").join(last, "source_key", "left"), "mix-cutoffs")


def mix_sources(
    docs: DataFrame,
    source_weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    keep_text: bool = True,
) -> DataFrame:
    """`docs` (doc_id, text, source, ...) with size, source_size, target, copies and taken.

    `copies` says how often the mix takes the row: its source's complete epochs, plus 1 if the
    fraction takes it. `taken` = copies * size. Without `keep_text` the text column goes, and the
    text is read once; with it, the second pass counts words again rather than moving texts.
    """
    keep = [c for c in docs.columns if c not in RESULT]
    slim_columns = [c for c in keep if c in ("doc_id", "source")]
    rows = _keyed(docs, keep if keep_text else slim_columns, seed)
    slim = _keyed(docs, slim_columns, seed).drop("text", *([] if not keep_text else ["row"]))
    slim = materialize(slim, "mix")
    cut = _cutoffs(slim, source_weights, share, max_epochs)
    if not keep_text:
        rows = slim
    mine, last = F.struct("key", "id", "size"), F.struct("last.key", "last.id", "last.size")
    edge = F.shiftright("bits", KEY_BITS - STEP_BITS * LEVELS)
    inside = (F.col("rest") > 0) & ((edge < F.col("edge")) | ((edge == F.col("edge")) & (mine <= last)))
    rows = rows.join(cut, "source_key").withColumn("in", F.coalesce(inside, F.lit(False)))
    out = ["row", "size", "source_size", "target", "epochs"]
    if cut.where("last.fit < last.n").limit(1).count():  # the cut-off falls among repeated rows: number those
        split = (mine == last) & (F.col("last.fit") < F.col("last.n"))
        split = F.coalesce(split, F.lit(False))
        whole = rows.where(~split).select(*out, "in")
        same = rows.where(split).groupBy("source_key", F.xxhash64("row").alias("h"), *out, F.col("last.fit").alias("fit")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("source_key").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        same = same.withColumn("before", before).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
        same = same.repartition("h", "k")  # so that one row's many repeats are made by many tasks
        last_k = F.least(F.col("n"), (F.col("k") + 1) * CHUNK) - 1
        same = same.withColumn("i", F.explode(F.sequence(F.col("k") * CHUNK, last_k)))
        rows = whole.unionByName(same.select(*out, (F.col("before") + F.col("i") < F.col("fit")).alias("in")))
    copies = F.col("epochs") + F.col("in").cast("int")
    new = F.struct("size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return rows.select("row", new.alias("new")).select("row.*", "new.*")


def repeat_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row as often as `copies` says."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("time")
    return mixed.where("copies > 0").select(F.struct(*columns).alias("row"), times).select("row.*")


def op1_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_sources(docs, keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0)::DOUBLE AS n,
         coalesce(length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::DOUBLE AS clean,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / ((n + 1) / (n + 1 + 20 * (n - clean))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
l AS (SELECT *,
        (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2 * source_size / w, rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * source_size / w, rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM r),
t AS (SELECT source, source_size,
        least(2.0::DOUBLE * source_size,
              CASE WHEN 2 * source_size / w <= level THEN 2.0::DOUBLE * source_size
                   ELSE w * max(level) OVER () END) AS target
      FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS prefix
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND 2 * prefix - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
