"""Confusion statistics, purities, subtree roll-ups, class samples and label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("cls"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))


def answers(c: DataFrame) -> DataFrame:
    """Per true class: count, success_count, success_rate, from ``confusion``."""
    ok = F.sum(F.when(F.col("cls") == F.col("pred"), F.col("n")).otherwise(0))
    return c.groupBy("cls").agg(F.sum("n").alias("count"), ok.alias("success_count"), (ok / F.sum("n")).alias("success_rate"))


def error_rate(c: DataFrame) -> DataFrame:
    ok = F.sum(F.when(F.col("cls") == F.col("pred"), F.col("n")).otherwise(0))
    return c.agg((1 - ok / F.sum("n")).alias("error_rate"))


def flat_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """clusters, sum, mean and size-weighted mean of each cluster's majority share."""
    t = df.groupBy(cluster, label).agg(F.count("*").alias("n")).groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return t.agg(F.count("*").alias("clusters"), F.sum(F.col("top") / F.col("size")).alias("sum_purity"), F.avg(F.col("top") / F.col("size")).alias("mean_purity"), (F.sum("top") / F.sum("size")).alias("weighted_purity"))


def prefixes(df: DataFrame, path: str) -> DataFrame:
    """A row for each node on the way to a member: node (the path's prefix as text) and depth."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.size(path))).alias("depth")).withColumn("node", F.concat_ws("/", F.slice(path, F.lit(1), F.col("depth"))))


def subtree_rollup(df: DataFrame, path: str, label: str) -> DataFrame:
    """node, depth, label, n: members below each node by class."""
    return prefixes(df, path).groupBy("node", "depth", label).agg(F.count("*").alias("n"))


def dendrogram_purity(df: DataFrame, path: str, label: str) -> DataFrame:
    """Mean, over pairs of one class, of that class's share below their lowest common ancestor; label 0 has no class.

    Pairs that meet at a node exactly are C(n_k, 2) minus its children's, so no pair is ever made.
    """
    roll = subtree_rollup(df.where(F.col(label) != 0), path, label)
    own = roll.withColumn("size", F.sum("n").over(Window.partitionBy("node"))).withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    up = own.where("depth > 0").select(F.when(F.instr("node", "/") > 0, F.regexp_replace("node", "/[^/]*$", "")).otherwise("").alias("node"), F.col(label), F.col("pairs").alias("below"))
    kids = up.groupBy("node", label).agg(F.sum("below").alias("below"))
    met = own.join(kids, ["node", label], "left").withColumn("met", F.col("pairs") - F.coalesce("below", F.lit(0.0)))
    return met.agg(F.sum("met").cast("long").alias("n_pairs"), (F.sum(F.col("met") * F.col("n") / F.col("size")) / F.sum("met")).alias("purity"))


def lca_depth(a: str, b: str) -> F.Column:
    """Depth of the lowest common ancestor of two path arrays: the length of their common prefix."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n")), lambda s: s["n"])


def class_sample(counts: DataFrame, n: int, seed: int) -> DataFrame:
    """n classes without replacement, those of at least mean size first, in a seeded order (MD5 of seed and label)."""
    mean = counts.agg(F.avg("n").alias("mean"))
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("label").cast("string")))
    return counts.crossJoin(F.broadcast(mean)).orderBy((F.col("n") >= F.col("mean")).desc(), mixed, "label").limit(n).select("label", "n")


def class_summary(counts: DataFrame) -> DataFrame:
    """classes, total, median and average size, largest class (the lower label among equals)."""
    top = F.max_by("label", F.struct("n", -F.col("label")))
    return counts.agg(F.count("*").alias("classes"), F.sum("n").alias("total"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("average"), top.alias("largest"))


def path_index(nodes: DataFrame, path: str) -> DataFrame:
    """Adds pre_order: the place of each node's path in a walk that meets parents before their children, from 0. Sorted in ranges; only their sizes are added up across them."""
    dealt = cut(nodes.repartitionByRange(F.col(path)).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = dealt.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).select("_r", before.alias("_first"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy(path)) - 1
    return dealt.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn("pre_order", place.cast("long")).drop("_range", "_r", "_first")


def ranges_join(points: DataFrame, offset: str, files: DataFrame) -> DataFrame:
    """Global offsets to (file, local offset). ``files``: file, start, stop. Both meet by steps as wide as the longest file, so a point sees a file or two of a list of any length."""
    wide = files.agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 1
    step = lambda c: c - F.pmod(c, F.lit(wide))
    stepped = files.where("start < stop").withColumn("_step", F.explode(F.sequence(step(F.col("start")), step(F.col("stop") - 1), F.lit(wide))))
    met = points.withColumn("_at", step(F.col(offset))).join(stepped, (F.col("_at") == F.col("_step")) & (F.col(offset) >= F.col("start")) & (F.col(offset) < F.col("stop")))
    return met.drop("_at", "_step").withColumn("local", F.col(offset) - F.col("start"))


def integrity(nodes: DataFrame) -> DataFrame:
    """Nodes (node, parent, child_index) whose parent is missing or whose index is not their rank among siblings."""
    w = Window.partitionBy("parent").orderBy("child_index")
    n = nodes.withColumn("rank", F.row_number().over(w) - 1)
    p = nodes.select(F.col("node").alias("p"))
    j = n.join(p, F.col("parent") == F.col("p"), "left")
    return j.agg(F.count_if(F.col("p").isNull() & F.col("parent").isNotNull()).alias("orphans"), F.count_if(F.col("rank") != F.col("child_index")).alias("misplaced"), F.count("*").alias("nodes"))


def fixed_child_index(nodes: DataFrame) -> DataFrame:
    """Children renumbered from 0 in their order; orphans dropped."""
    w = Window.partitionBy("parent").orderBy("child_index", "node")
    kept = nodes.join(nodes.select(F.col("node").alias("p")), F.col("parent") == F.col("p"), "left").where("p IS NOT NULL OR parent IS NULL").drop("p")
    return kept.withColumn("child_index", (F.row_number().over(w) - 1).cast("long"))
