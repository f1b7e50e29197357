"""Whole jobs out of the operators: select regions, take over ids, check a layer, run a batch.

Each returns rows; reports and messages are rows too. Nothing is gathered but one row a selection or a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import codes, rings, snap, spatial
from .graph import cut

WORLD = "world"


def _unbracketed(title: Column) -> Column:
    """A title without its last words in brackets; null if there are none or nothing else."""
    bare = F.trim(F.regexp_extract(title, r"^(.*) \([^(]*\)\s*$", 1))
    return F.when(bare != "", bare)


def pick_regions(inputs: DataFrame, regions: DataFrame) -> DataFrame:
    """(sel, pos, input, code): the region that each input of a selection means; null if there is none.

    inputs: (sel, pos, input); regions: (code, level, name, aliases). An input is a code as it stands, or whatever its case, or a
    name or alias; a title with words in brackets is looked up again without them. Of several regions the lowest level counts,
    then the country (a subdivision's code up to the first dash) of most inputs that mean just one region, then the code.
    """
    r = regions.select("code", "level", F.lower("name").alias("name"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower).alias("aliases"))
    key = lambda stage, name: F.struct(F.lit(stage).alias("stage"), name.alias("key"))
    names = F.array_distinct(F.concat(F.array("name"), "aliases"))
    known = r.select("code", "level", F.explode(F.concat(F.array(key(0, F.col("code")), key(1, F.lower("code"))), F.transform(names, lambda n: key(2, n)))).alias("k")).select("code", "level", "k.*")
    known = known.where("key IS NOT NULL")
    given, bare = F.trim("input"), _unbracketed(F.trim("input"))
    tries = F.array(*(F.struct(F.lit(t + 3 * again).alias("turn"), F.lit(t).alias("stage"), (v if t == 0 else F.lower(v)).alias("key")) for again, v in ((0, given), (1, bare)) for t in (0, 1, 2)))
    asked = inputs.select("sel", "pos", "input", F.explode(tries).alias("t")).select("sel", "pos", "t.*").where("key IS NOT NULL AND key <> ''")
    hits = cut(asked.join(known, ["stage", "key"]))
    first = hits.groupBy("sel", "pos").agg(F.min("turn").alias("turn"))
    found = hits.join(first, ["sel", "pos", "turn"])
    one = found.where("stage < 2").groupBy("sel", "pos").agg(F.min_by("level", "code").alias("level"), F.min("code").alias("code"))  # a code is one region
    found = cut(one.select("sel", "pos", "code", "level").unionByName(found.where("stage = 2").select("sel", "pos", "code", "level").distinct()))
    found = found.withColumn("country", F.when(F.col("level") > 0, F.split("code", "-")[0]))
    sure = found.groupBy("sel", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("country").alias("country")).where("n = 1 AND country IS NOT NULL")
    shared = sure.groupBy("sel", "country").agg(F.count(F.lit(1)).alias("shared"))
    ranked = found.join(shared, ["sel", "country"], "left")
    best = ranked.groupBy("sel", "pos").agg(F.min_by("code", F.struct(F.col("level"), -F.coalesce("shared", F.lit(0)), F.col("code"))).alias("code"))
    return inputs.join(best, ["sel", "pos"], "left").select("sel", "pos", "input", "code")


def selections(picked: DataFrame) -> DataFrame:
    """(sel, code, error): each selection's codes joined by commas, or why it is none."""
    g = picked.groupBy("sel").agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.min_by("input", F.when(F.col("code").isNull(), F.col("pos"))).alias("unknown"), F.count_if(F.col("code").isNull()).alias("n_unknown"),
    )
    mixed = (F.size("codes") > 1) & F.array_contains("codes", WORLD)
    error = F.when(F.col("n_unknown") > 0, F.concat(F.lit("no region "), "unknown")).when(mixed, F.lit("world can't be combined with other regions"))
    return g.select("sel", F.when(error.isNull(), F.array_join("codes", ",")).alias("code"), error.alias("error"))


def take_ids(records: DataFrame, references: DataFrame, min_share: float = 0.5, size: float = 1.0) -> DataFrame:
    """`records` (pos, geometry, ...) with code and parent of the reference (code, parent, geometry) that is the same place, and
    `reused`: an earlier record has the code already. Records without a match keep nulls.
    """
    box = lambda df, name: cut(df.select(F.col(name).alias("id"), "geometry").where(F.size("geometry") > 0).withColumns(spatial.polygon_box("geometry") | {"area": spatial.polygon_area("geometry")}))
    refs = cut(references.select("code", "parent", "geometry"))
    pairs = spatial.dealt(spatial.box_pairs(box(records, "pos"), box(refs, "code"), size)).withColumn("overlap", spatial.intersection_area("geometry", "geometry_b"))
    m = spatial.best_match(pairs, F.col("overlap"), F.col("area"), F.col("area_b"), min_share)
    m = cut(m.where("overlap > 0").select(F.col("id").alias("pos"), F.col("id_b").alias("code")))
    first = m.groupBy("code").agg(F.min("pos").alias("first"))
    found = m.join(first, "code").join(refs.select("code", "parent"), "code", "left")
    found = found.select("pos", "code", "parent", (F.col("pos") > F.col("first")).alias("reused"))
    return records.drop("code", "parent", "reused").join(found, "pos", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def take_report(records: DataFrame, name: Column, most: int = 8) -> DataFrame:
    """One row: matched, total, codes used again, and the first unmatched records' names (of those without one their place)."""
    label = F.when(F.col("code").isNull(), F.struct("pos", F.coalesce(name, F.concat(F.lit("#"), F.col("pos").cast("string"))).alias("name")))
    rows = records.select("code", "reused", "pos", label.alias("gap"))
    first = rows.where("gap IS NOT NULL").orderBy("pos").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list("gap")), lambda g: g["name"]), ", ").alias("shown"))
    n = rows.agg(F.count("code").alias("matched"), F.count(F.lit(1)).alias("total"), F.count_if("reused").alias("reused"), F.count("gap").alias("gaps"))
    more = F.when(F.col("gaps") > most, F.concat(F.lit(" and "), (F.col("gaps") - most).cast("string"), F.lit(" more"))).otherwise("")
    return n.join(F.broadcast(first)).select("matched", "total", "reused", F.concat("shown", more).alias("unmatched"))  # one row each


def ring_rows(features: DataFrame) -> DataFrame:
    """(feature, part, ring, pos, x, y) of polygon geometries."""
    parts = features.select("feature", F.posexplode("geometry").alias("part", "rings"))
    ring = parts.select("feature", "part", F.posexplode("rings").alias("ring", "points"))
    return ring.select("feature", "part", "ring", F.posexplode("points").alias("pos", "p")).select("feature", "part", "ring", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def check_layer(features: DataFrame, tolerance: float = 1e-4, overlap: float = 1e-4, size: float = 1.0) -> DataFrame:
    """All issues of a layer (feature long, id, geometry), computed from its shapes: (feature, kind, detail, other)."""
    vertices = cut(ring_rows(features))
    full = F.coalesce(F.size("geometry") > 0, F.lit(False))
    polygon = features.where(full).select("feature", F.posexplode("geometry").alias("part", "rings"))
    ring = polygon.select("feature", F.array("rings").alias("one"), F.col("rings")[0].alias("outer"))
    n = F.size("outer")
    length = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda t, i: t + F.hypot(F.col("outer")[i][0] - F.col("outer")[(i + 1) % n][0], F.col("outer")[i][1] - F.col("outer")[(i + 1) % n][1]))
    parts = ring.where(n > 0).select("feature", spatial.polygon_area("one").alias("area"), length.alias("perimeter"))
    boxes = cut(features.where(full).select(F.col("feature").alias("id"), "geometry").withColumns(spatial.polygon_box("geometry") | {"area": spatial.polygon_area("geometry")}))
    pairs = spatial.dealt(spatial.box_pairs(boxes, boxes, size).where("id < id_b")).withColumn("overlap", spatial.intersection_area("geometry", "geometry_b"))
    overlaps = spatial.self_overlaps(pairs, F.col("overlap"), F.col("area"), F.col("area_b"), overlap)
    open_ = vertices.join(vertices.groupBy(*rings.RING).agg(F.max("pos").alias("pos")), [*rings.RING, "pos"], "left_anti")  # without closing vertices
    v = cut(open_.withColumns({"pid": F.monotonically_increasing_id(), "owner": F.col("feature")}))
    edge = rings.edges(vertices)
    outline = cut(edge.select(F.col("feature").alias("owner"), F.monotonically_increasing_id().alias("sid"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by")))
    near = spatial.near_misses(v, outline, tolerance)
    invalid = rings.polygon_problem(edge, size)
    return rings.issues(features.select("feature", "id", (~full).alias("empty")), vertices, parts, overlaps, near, invalid)


OUTCOME = "file string, region string, name string, features long, output string, error string"


def run_batch(features: DataFrame, render: Callable[[pd.DataFrame], str], name: Column) -> DataFrame:
    """One job a file and region of `features` (file, region, ...): (file, region, name, features, output, error).

    A job that fails is a row with its error and stops no other. Jobs whose names (by file and region) are another's too are not
    run. A job's features come to one task.
    """
    jobs = features.select("file", "region").distinct().withColumn("name", name)
    twice = cut(jobs.withColumn("jobs", F.count(F.lit(1)).over(W.partitionBy("name"))))

    def job(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        output = error = None
        if rows["jobs"].iloc[0] > 1:
            error = f"{key[2]} is the name of several jobs"
        else:
            try:
                output = render(rows)
            except Exception as e:  # whatever a job dies of belongs to its own row
                error = f"{type(e).__name__}: {e}"
        return pd.DataFrame([(*key, len(rows), output, error)], columns=[c.split()[0] for c in OUTCOME.split(", ")])

    return features.join(twice, ["file", "region"]).groupBy("file", "region", "name").applyInPandas(job, OUTCOME)


def batch_report(outcomes: DataFrame, share_alike: Column) -> DataFrame:
    """One row: jobs that gave an output, those that failed, and the names of outputs under a share-alike licence."""
    done = F.col("output").isNotNull()
    listed = F.array_sort(F.collect_set(F.when(done & share_alike, F.col("name"))))
    return outcomes.agg(F.count_if(done).alias("done"), F.count_if(~done).alias("failed"), F.array_join(listed, ", ").alias("share_alike"))


def picker(subject: DataFrame, context: DataFrame, regions: DataFrame) -> DataFrame:
    """Ids of the subject (id) that are regions (id); if there are none, those of the context."""
    own = cut(subject.select("id").join(regions.select("id"), "id", "left_semi").distinct())
    some = own.agg((F.count(F.lit(1)) > 0).alias("some"))  # one row
    other = context.select("id").join(regions.select("id"), "id", "left_semi").distinct().join(F.broadcast(some)).where("NOT some").drop("some")
    return own.unionByName(other)


def bridge(old: DataFrame, new: DataFrame, keys: tuple[str, str], unit: str, amount: str) -> DataFrame:
    """(old key, new key, amount): what moved from old areas to new ones, by units that kept their code in both; `amount` is summed."""
    a = old.groupBy(keys[0], unit).agg(F.sum(amount).alias(amount))
    return a.join(new.select(keys[1], unit).distinct(), unit).groupBy(*keys).agg(F.sum(amount).alias(amount))


def shapes_of(rows: DataFrame) -> DataFrame:
    """(feature, geometry) of ring rows (feature, part, ring, pos, x, y); a feature's parts and a part's rings in their order."""
    in_order = lambda at, value: F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda s: s[value])
    ring = rows.withColumn("p", F.array("x", "y")).groupBy(*rings.RING).agg(in_order("pos", "p").alias("points"))
    part = ring.groupBy("feature", "part").agg(in_order("ring", "points").alias("rings"))
    return part.groupBy("feature").agg(in_order("part", "rings").alias("geometry"))


def convert(
    records: DataFrame, tolerance: float | None = None, references: DataFrame | None = None, min_share: float = 0.5,
    codes_from: tuple[DataFrame, Column] | None = None, names: DataFrame | None = None, prefix: str = "",
) -> tuple[DataFrame, DataFrame]:
    """A layer made ready for writing, and a report (step, done, total, detail).

    records: (pos long, name, geometry, ...). In this order, each step only if it is asked for: shapes are repaired within the
    tolerance; ids are taken from references (code, parent, geometry) that are the same place; codes from a table (key, value),
    by the records' column given with it; parents are named by names (key, value), with or without the prefix.
    """
    spark, done = records.sparkSession, []
    report = "step string, done long, total long, detail string"
    out = records
    if tolerance is not None:
        fixed, summary = snap.repair(ring_rows(out.select(F.col("pos").alias("feature"), "geometry")), tolerance)
        shapes = shapes_of(fixed).withColumnRenamed("feature", "pos")
        areal = F.coalesce(F.size("geometry") > 0, F.lit(False))
        out = out.withColumn("_areal", areal).drop("geometry").join(shapes, "pos", "left").withColumn("geometry", F.when(F.col("_areal"), F.coalesce("geometry", F.array().cast(spatial.POLYGON)))).drop("_areal")
        detail = ", ".join(f"{k} {v}" for k, v in summary.items())
        done.append(spark.createDataFrame([("repair", int(summary["fixed_polygons"]), records.count(), detail)], report))
    if references is not None:
        out = cut(take_ids(out, references, min_share))
        r = take_report(out, F.col("name"))
        done.append(r.select(F.lit("ids").alias("step"), F.col("matched").alias("done"), "total", F.concat(F.col("reused").cast("string"), F.lit(" codes used again; unmatched: "), "unmatched").alias("detail")))
    if codes_from is not None:
        table, match = codes_from
        clear, unclear = codes.lookup(table, "key", "value")
        had = out.withColumn("_had", F.col("code")) if "code" in out.columns else out.withColumn("_had", F.lit(None).cast("string"))
        out = codes.assign_codes(had.drop("code"), match, clear).withColumn("code", F.coalesce("code", "_had")).drop("_had")
        n = unclear.agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("keys"))  # ambiguous keys of a code table
        r = out.agg(F.count_if("matched").alias("done"), F.count(F.lit(1)).alias("total")).join(F.broadcast(n))
        done.append(r.select(F.lit("codes").alias("step"), "done", "total", F.concat(F.lit("ambiguous: "), "keys").alias("detail")))
        out = out.drop("matched")
    if names is not None:
        out = codes.parent_names(out if "parent" in out.columns else out.withColumn("parent", F.lit(None).cast("string")), "parent", names, prefix)
        missing = codes.unmatched_parents(out, "parent", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "parent"))), lambda s: s["parent"]), ", ").alias("gaps"))
        r = out.agg(F.count("parent_name").alias("done"), F.count(F.lit(1)).alias("total")).join(F.broadcast(missing))
        done.append(r.select(F.lit("parents").alias("step"), "done", "total", F.concat(F.lit("without a name: "), "gaps").alias("detail")))
    told = spark.createDataFrame([], report)
    for r in done:
        told = told.unionByName(r)
    return out, told
