"""Connected components and category graphs, as joins repeated to a fixpoint, however many rounds that takes.

Each round's result is cut off by checkpoint() in the folder named by spark.checkpoint.dir; where that is
unset, a local session gets a temporary folder and any other one uses its warehouse, if that isn't a machine's own folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once, without lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="regionloom-")
        if not folder:
            folder = df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
            if folder.startswith(("file:", "/")):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share; the warehouse is a local one")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that `edges` (u, v) connect each node with.

    Labels take the smallest of their neighbours', then jump to their label's own label, which
    halves the remaining distance.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = cut(both)
    label = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "node")
    label = cut(label)
    while True:
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("c").alias("m"))
        step = label.join(near, label.node == near.u).select("node", F.least("c", "m").alias("n"), "c")
        jump = step.select(F.col("node").alias("n"), F.col("n").alias("nn"))
        step = cut(step.join(jump, "n", "left").select("node", F.least("n", F.coalesce("nn", "n")).alias("n"), "c"))
        changed = step.where("n <> c").limit(1).count()
        label = step.select("node", F.col("n").alias("c"))
        if not changed:
            break
    return label.select("node", F.col("c").alias("component"))


def cluster_weights(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """(component, weight, members): area times |cos latitude|, and the members in order."""
    w = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * F.abs(F.cos(F.radians((F.col("y0") + F.col("y1")) / 2)))
    rooted = boxes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return rooted.groupBy("component").agg(F.sum(w).alias("weight"), F.array_sort(F.collect_list("id")).alias("members"))


def top_clusters(clusters: DataFrame, k: int, least_share: float = 2.5e-4) -> DataFrame:
    """Of the clusters after the heaviest, the k heaviest with at least least_share of its weight."""
    order = [F.col("weight").desc(), F.col("component")]
    head = clusters.orderBy(*order).limit(1).select(F.col("weight").alias("main"), F.col("component").alias("main_component"))
    rest = clusters.join(F.broadcast(head), F.col("component") != F.col("main_component"))  # one row
    return rest.where(F.col("weight") >= F.col("main") * least_share).orderBy(*order).limit(k).select("component", "weight")


def category_tree(links: DataFrame, root: str) -> DataFrame:
    """(category, level): breadth-first distance below `root` over links (parent, child); cycles end where they close."""
    edge = cut(links.sparkSession.createDataFrame([(root, 0)], "category string, level int"))
    seen, level = edge, 0  # the levels found so far, each written once
    while True:
        level += 1
        step = links.join(edge.select(F.col("category").alias("parent")), "parent", "left_semi").select(F.col("child").alias("category")).distinct()
        edge = cut(step.join(seen, "category", "left_anti").withColumn("level", F.lit(level)))
        if not edge.limit(1).count():
            return seen
        seen = seen.unionByName(edge)


def category_members(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(category, level, parents, children): the tree's categories with their direct neighbours in it, sorted."""
    inside = links.join(tree.select(F.col("category").alias("parent")), "parent").join(tree.select(F.col("category").alias("child")), "child").distinct()
    up = inside.groupBy(F.col("child").alias("category")).agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    down = inside.groupBy(F.col("parent").alias("category")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    out = tree.join(up, "category", "left").join(down, "category", "left")
    none = F.array().cast("array<string>")
    return out.select("category", "level", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def longest_depth(links: DataFrame, root: str) -> DataFrame:
    """(category, depth): the longest path from `root`. Members of a cycle below the root and all that hangs on one have no
    longest path: their depth is null.

    Categories leave in topological order, those first whose parents have all left.
    """
    tree = category_tree(links, root).select("category")
    edges = cut(
        links.select("parent", "child").distinct()
        .join(tree.select(F.col("category").alias("parent")), "parent", "left_semi")
        .join(tree.select(F.col("category").alias("child")), "child", "left_semi")
    )
    waits = edges.groupBy(F.col("child").alias("category")).agg(F.count(F.lit(1)).alias("left"))
    open_ = cut(tree.join(waits, "category", "left").select("category", F.coalesce("left", F.lit(0)).cast("long").alias("left"), F.lit(0).alias("depth")))
    done = None
    while True:
        ready = cut(open_.where("left = 0").select("category", "depth"))
        if not ready.limit(1).count():
            break
        done = ready if done is None else done.unionByName(ready)
        step = edges.join(ready.withColumnRenamed("category", "parent"), "parent").groupBy(F.col("child").alias("category"))
        step = step.agg(F.count(F.lit(1)).alias("n"), (F.max("depth") + 1).alias("d"))
        rest = open_.where("left > 0").join(step, "category", "left")
        open_ = cut(rest.select("category", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth")))
    rest = open_.select("category", F.lit(None).cast("int").alias("depth"))
    return rest if done is None else done.unionByName(rest)
