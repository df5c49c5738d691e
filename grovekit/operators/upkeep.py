"""Questions about a saved or growing cluster tree, and its repair: path, kind (node or entry), cf, cluster (an entry's number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _above(path: str, last: int = -1) -> Column:
    """The depths of a path's prefixes, from the root's on; ``last`` is 0 if the path itself counts."""
    return F.filter(F.sequence(F.lit(0), F.size(path)), lambda k: k <= F.size(path) + last)


def _up(path: str) -> Column:
    """The parent's path; the root has none."""
    return F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))


def with_inner(entries: DataFrame) -> DataFrame:
    """path, kind, cf, cluster of the entries (path, cf, cluster) and of every node above them, whose features are sums with map-side combining."""
    p = entries.select("cf", "path", F.explode(_above("path")).alias("_d")).select("cf", F.slice("path", F.lit(1), F.col("_d")).alias("path"))
    sums = p.groupBy("path").agg(F.sum("cf.n").alias("n"), F.sum("cf.ss").alias("ss"))
    dims = p.select("path", F.posexplode("cf.ls").alias("_i", "_x")).groupBy("path", "_i").agg(F.sum("_x").alias("_x"))
    ls = dims.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda t: t["_x"]).alias("ls"))
    cf = F.struct("n", F.coalesce("ls", F.array().cast("array<double>")).alias("ls"), "ss").cast(entries.schema["cf"].dataType)
    inner = sums.join(ls, "path", "left").select("path", F.lit("node").alias("kind"), cf.alias("cf"), F.lit(None).cast("long").alias("cluster"))
    return inner.unionByName(entries.select("path", F.lit("entry").alias("kind"), "cf", F.col("cluster").cast("long").alias("cluster")))


def inconsistencies(nodes: DataFrame) -> DataFrame:
    """What is wrong with each node: path, kind, orphan, copies, children, gaps, n_off, ls_off, ss_off. Sound nodes have a row too.

    ``orphan``: no node has the parent's path. ``copies``: rows of this path and kind. ``gaps``: the children's positions aren't 0 to children - 1.
    The last three are what a node says less what its children say, ``ls_off`` the largest over dimensions; null for entries and childless nodes.
    """
    own = nodes.groupBy("path", "kind").agg(F.count("*").alias("copies"), F.min("cf").alias("cf"))
    inner = nodes.where("kind = 'node'").select(F.col("path").alias("_p")).distinct()
    held = own.withColumn("_up", _up("path")).join(inner, F.col("_up") == F.col("_p"), "left").withColumn("orphan", F.col("_up").isNotNull() & F.col("_p").isNull()).drop("_up", "_p")
    kids = nodes.where(F.size("path") > 0).select(_up("path").alias("_p"), F.element_at("path", -1).alias("_at"), "cf")
    sums = kids.groupBy("_p").agg(F.count("*").alias("children"), (F.min("_at") != 0).alias("_low"), (F.max("_at") + 1).alias("_high"), F.count_distinct("_at").alias("_places"), F.sum("cf.n").alias("_n"), F.sum("cf.ss").alias("_ss"))
    dims = kids.select("_p", F.posexplode("cf.ls").alias("_i", "_x")).groupBy("_p", "_i").agg(F.sum("_x").alias("_x"))
    ls = dims.groupBy(F.col("_p").alias("_q")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda t: t["_x"]).alias("_ls"))
    below = sums.join(ls, F.col("_p") == F.col("_q"), "left").withColumn("_kind", F.lit("node"))
    both = held.join(below, (F.col("path") == F.col("_p")) & (F.col("kind") == F.col("_kind")), "left")
    off = F.array_max(F.zip_with("cf.ls", "_ls", lambda x, y: F.abs(x - y)))
    gaps = F.coalesce(F.col("_low") | (F.col("_high") != F.col("children")) | (F.col("_places") != F.col("children")), F.lit(False))
    return both.select("path", "kind", "orphan", "copies", F.coalesce("children", F.lit(0)).alias("children"), gaps.alias("gaps"), (F.col("cf.n") - F.col("_n")).alias("n_off"), off.alias("ls_off"), (F.col("cf.ss") - F.col("_ss")).alias("ss_off"))


def repaired(nodes: DataFrame) -> DataFrame:
    """The tree of all entries that the root still reaches, with positions from 0 without gaps and every inner node the sum of its entries.

    Children keep their order; those in one place get places of their own, an inner node first, then entries by number. Entries whose
    ancestors are not all there go, as do nodes without entries. Entries' numbers are unique. Nothing grows beyond a node's children in one task.
    """
    entries = nodes.where("kind = 'entry'").select("path", "cf", F.col("cluster").cast("long").alias("cluster"))
    inner = nodes.where("kind = 'node'").select(F.col("path").alias("_p")).distinct()
    above = entries.select("cluster", "path", F.explode(_above("path")).alias("_d")).withColumn("_a", F.slice("path", F.lit(1), F.col("_d")))
    there = above.join(inner, F.col("_a") == F.col("_p"), "left_semi").groupBy("cluster").agg(F.count("*").alias("_n"))
    sound = entries.join(there, "cluster", "left").where((F.size("path") == F.coalesce("_n", F.lit(0))) & (F.size("path") > 0)).drop("_n")
    between = sound.select("path", F.explode(_above("path")).alias("_d")).where("_d > 0").select(F.slice("path", F.lit(1), F.col("_d")).alias("_a")).distinct()
    kids = between.select(F.col("_a"), F.lit(None).cast("long").alias("_c")).unionByName(sound.select(F.col("path").alias("_a"), F.col("cluster").alias("_c")))
    place = Window.partitionBy(_up("_a")).orderBy(F.element_at("_a", -1), F.col("_c").asc_nulls_first())  # one node's children
    placed = kids.withColumn("_at", (F.row_number().over(place) - 1).cast("int"))
    way = sound.select("cluster", "path", F.explode(_above("path")).alias("_d")).where("_d > 0").withColumn("_k", F.slice("path", F.lit(1), F.col("_d")))
    steps = way.join(placed.where("_c IS NULL").drop("_c"), F.col("_k") == F.col("_a")).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_at"))), lambda t: t["_at"]).alias("_way"))
    last = placed.where("_c IS NOT NULL").select(F.col("_c").alias("cluster"), F.col("_at").alias("_last"))
    moved = sound.drop("path").join(steps, "cluster", "left").join(last, "cluster")
    return with_inner(moved.select(F.concat(F.coalesce("_way", F.array().cast("array<int>")), F.array("_last")).alias("path"), "cf", "cluster"))
