"""Trees given by parent pointers: depth, path, walk order and subtree sums in as many rounds as the depth has binary digits.

A node knows an ancestor some steps up and what it gathered on the way; joined with what that ancestor knows, it sees
twice as far. Nodes that have reached their top drop out of the joins, so only far ones go on. Nodes on cycles never do: they
are found by their jumps alone, and paths, which double with every round, are only gathered by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written


def _doubled(state: DataFrame, joined: dict[str, Column], rounds: int, each=None) -> DataFrame:
    """``state``: node, jump (null at the top) and what was gathered; ``joined`` says how that of a node (s) and of its jump (t) join.

    A round in which no node gets to its top is the last one, as all that are left are on cycles or below them.
    """
    whole, before = written(state), None
    for k in range(rounds):
        open_ = whole.where("jump IS NOT NULL")
        left = open_.count()
        if left in (0, before):
            break
        before = left
        if each:
            each(k, open_)
        s, t = open_.alias("s"), whole.alias("t")
        new = s.join(t.hint("merge"), F.col("s.jump") == F.col("t.node")).select(F.col("s.node").alias("node"), F.col("t.jump").alias("jump"), *[c.alias(n) for n, c in joined.items()])
        whole = written(whole.where("jump IS NULL").unionByName(new))
    return whole.where("jump IS NULL")


def hierarchy(nodes: DataFrame, node: str = "node", parent: str = "parent", weight: str | None = None) -> DataFrame:
    """node, parent, status, depth, top, path, size, total, pre_order of each node (a long).

    status: ok, orphan (its way up ends at a parent that is no node; depth and path count from there) or cycle (it ends nowhere: the rest is
    null). top: where the way up ends. size and total: nodes and ``weight`` below and at the node. pre_order: parents before children, siblings and
    tops by their numbers, from 0. Null nodes are left out; of a node's several rows the one with the smallest parent counts (null is smallest).
    A path is as long as its depth.
    """
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    one = nodes.where(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"), F.coalesce(w, F.lit(0.0)).alias("w"))
    one = one.groupBy("node").agg(F.min(F.struct(F.col("parent").isNotNull().alias("has"), "parent", "w")).alias("m")).select("node", "m.parent", "m.w")
    known = one.select(F.col("node").alias("_p"))
    base = written(one.join(known.hint("merge"), F.col("parent") == F.col("_p"), "left").withColumn("jump", F.col("_p")).drop("_p"))
    n = base.count()
    rounds = n.bit_length() + 1
    # the way up; whoever never gets to its end is on a cycle or below one
    start = base.select("node", "jump", F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("jump", "node").alias("top"))
    ends = _doubled(start, {"depth": F.col("s.depth") + F.col("t.depth"), "top": F.col("t.top")}, rounds)
    tree = written(base.join(ends.select("node", "depth", "top").hint("merge"), "node"))
    # sums over the nodes less than 2, 4, 8 ... steps below
    sums = tree.select("node", F.lit(1).cast("long").alias("size"), F.col("w").alias("total"))

    def below(_: int, far: DataFrame) -> None:
        nonlocal sums
        add = far.join(sums.hint("merge"), "node").groupBy("jump").agg(F.sum("size").alias("_s"), F.sum("total").alias("_t"))
        sums = written(sums.join(add.hint("merge"), F.col("node") == F.col("jump"), "left").select("node", (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total")))

    paths = _doubled(tree.select("node", "jump", F.array("node").alias("path")), {"path": F.concat("t.path", "s.path")}, rounds, below)
    sized = written(tree.join(sums.hint("merge"), "node"))
    # a node comes after its parent and all that is below its earlier siblings; tops are siblings
    k = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sized.select(F.percentile_approx("node", F.array(*[F.lit((i + 1) / k) for i in range(k)]), 10_000)).first()[0] or [0]
    some = sized.select("node", "jump", "size", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("node"))).alias("_b"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = some.groupBy(F.col("jump").alias("_j"), F.col("_b").alias("_c")).agg(F.sum("size").alias("_s"))  # siblings by ranges of their numbers: no task has all of a node's children
    totals = totals.select("_j", "_c", F.sum("_s").over(up_to(Window.partitionBy("_j").orderBy("_c"))).alias("_before"))
    some = some.withColumn("_here", F.sum("size").over(up_to(Window.partitionBy("jump", "_b").orderBy("node")))).join(totals.hint("merge"), F.col("jump").eqNullSafe(F.col("_j")) & (F.col("_b") == F.col("_c")))
    step = some.select("node", "jump", (F.coalesce("_before", F.lit(0)) + F.coalesce("_here", F.lit(0)) + F.col("jump").isNotNull().cast("long")).alias("pre"))
    place = _doubled(step, {"pre": F.col("s.pre") + F.col("t.pre")}, rounds).select("node", F.col("pre").alias("pre_order"))
    whole = sized.join(place.hint("merge"), "node").join(paths.select("node", "path").hint("merge"), "node").select("node", "depth", "top", "path", "size", "total", "pre_order")
    tops = base.where("jump IS NULL").select(F.col("node").alias("_top"), F.col("parent").isNull().alias("_root"))
    out = base.select("node", "parent").join(whole.hint("merge"), "node", "left").join(tops.hint("merge"), F.col("top") == F.col("_top"), "left")
    status = F.when(F.col("top").isNull(), "cycle").when(F.col("_root"), "ok").otherwise("orphan")
    return out.select("node", "parent", status.alias("status"), "depth", "top", "path", "size", "total", "pre_order")
