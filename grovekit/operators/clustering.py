"""Clustering features (n, linear sum, square sum): algebra, distances D0 to D4, nearest and farthest, split assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written

D = ("d0", "d1", "d2", "d3", "d4")

#: A distance by name, or any function of two feature columns (n, ls, ss) that gives a column of doubles.
Distance = str | Callable[[Column, Column], Column]


def features(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """group, n, ls (array<double>), ss. Dimensions are summed with map-side partial aggregation."""
    dims = df.select(*group, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("dim", "x"))
    sums = dims.groupBy(*group, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    return sums.groupBy(*group).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda p: p["s"]).alias("ls"), F.sum("q").alias("ss"))


def plus(a: str, b: str, sign: int = 1) -> Column:
    """struct(n, ls, ss) of two feature columns added or taken off."""
    return F.struct((F.col(f"{a}.n") + sign * F.col(f"{b}.n")).alias("n"), F.zip_with(f"{a}.ls", f"{b}.ls", lambda x, y: x + sign * y).alias("ls"), (F.col(f"{a}.ss") + sign * F.col(f"{b}.ss")).alias("ss"))


def centroid(cf: str) -> Column:
    return F.transform(f"{cf}.ls", lambda x: x / F.col(f"{cf}.n"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distance(kind: Distance, a: str | Column, b: str | Column, literal: bool = False) -> Column:
    """Of two feature columns: d0 squared Euclid and d1 Manhattan between centroids, d2 average inter-cluster, d3 average intra-cluster distance, d4 variance increase.

    ``literal`` gives the older forms of d2 to d4, which turn NaN or negative for clusters of several points. A function is called with both columns.
    """
    if callable(kind):
        return kind(*(F.col(x) if isinstance(x, str) else x for x in (a, b))).cast("double")
    n1, n2, l1, l2, s1, s2 = ((F.col(x) if isinstance(x, str) else x)[k] for k in ("n", "ls", "ss") for x in (a, b))
    n1, n2 = n1.cast("double"), n2.cast("double")
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p * q))
    diff = F.zip_with(l1, l2, lambda x, y: x / n1 - y / n2)
    root = lambda c: F.when(c >= 0, F.sqrt(c)).otherwise(F.lit(float("nan")))
    if kind == "d0":
        return _sum(F.transform(diff, lambda x: x * x))
    if kind == "d1":
        return _sum(F.transform(diff, lambda x: F.abs(x)))
    if kind == "d2":
        return root((s1 + s2 - 2 * dot(l1, l2)) / (n1 * n2)) if literal else root(F.greatest((n2 * s1 + n1 * s2 - 2 * dot(l1, l2)) / (n1 * n2), F.lit(0.0)))
    n = n1 + n2
    if kind == "d3":
        if literal:
            return root((s1 + s2 - 2 * dot(l1, l2)) / (n * (n - 1)))
        both = F.zip_with(l1, l2, lambda x, y: x + y)
        return root(F.greatest((2 * n * (s1 + s2) - 2 * dot(both, both)) / (n * (n - 1)), F.lit(0.0)))
    if kind == "d4":
        if literal:
            s = F.zip_with(l1, l2, lambda x, y: (x + y) / n)
            term = lambda x, nx: _sum(F.zip_with(x, s, lambda p, q: (p - q) * (p - q) - (p - p / nx) * (p - p / nx)))
            return term(l1, n1) + term(l2, n2)
        return n1 * n2 / n * _sum(F.transform(diff, lambda x: x * x))
    raise ValueError(kind)


#: Bytes of clusters that a task holds at once.
BLOCK_BYTES = 16 << 20


def nearest(points: DataFrame, clusters: DataFrame, kind: Distance = "d0") -> DataFrame:
    """Each point's nearest cluster: id, cluster, distance. ``points``: id, cf; ``clusters``: cluster, cf, of any number. A row for each row of points.

    Clusters come to the tasks as one row per block of ``BLOCK_BYTES``; points stay where they are and keep the best so far, so nothing is
    shuffled or grouped. Ties go to the lower cluster; NaN distances come last. Without clusters, cluster and distance are null.
    """
    size = clusters.agg(F.count("*").alias("n"), F.max(F.size("cf.ls")).alias("dim")).first()
    blocks = max(1, -(-(size["n"] or 0) * (8 * (size["dim"] or 0) + 40) // BLOCK_BYTES))
    dealt = clusters.withColumn("_b", F.pmod(F.xxhash64("cluster"), F.lit(blocks)))
    out = points.select("id", F.col("cf").alias("_p")).withColumn("_best", F.lit(None).cast(f"struct<bad:boolean,d:double,cluster:{clusters.schema['cluster'].dataType.simpleString()}>"))
    for k in range(blocks):
        held = dealt.where(F.col("_b") == k).agg(F.collect_list(F.struct("cluster", "cf")).alias("_block"))  # one row of BLOCK_BYTES

        def measured(c: Column) -> Column:
            d = distance(kind, F.col("_p"), c["cf"])
            return F.struct(F.isnan(d).alias("bad"), d.alias("d"), c["cluster"].alias("cluster"))

        here = F.array_min(F.transform("_block", measured))
        out = out.join(F.broadcast(held)).withColumn("_best", F.array_min(F.array_compact(F.array("_best", here)))).drop("_block")
    return out.select("id", F.col("_best.cluster").alias("cluster"), F.col("_best.d").alias("distance"))


def equal_or_nearest(points: DataFrame, clusters: DataFrame, kind: str = "d0") -> DataFrame:
    """``nearest`` where many points are a cluster's centre (d0 and d1): these are found by a join, and only the others measure their distances to all."""
    if kind not in ("d0", "d1"):
        raise ValueError("only d0 and d1 are distances of centres")
    centre = lambda cf: F.when(F.forall(f"{cf}.ls", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.transform(f"{cf}.ls", lambda v: v / F.col(f"{cf}.n")))
    at = clusters.select(centre("cf").alias("_at"), "cluster").where("_at IS NOT NULL").groupBy("_at").agg(F.min("cluster").alias("cluster"))
    met = written(points.select("id", "cf", centre("cf").alias("_at")).join(at.hint("merge"), "_at", "left").drop("_at"))
    found = met.where("cluster IS NOT NULL").select("id", "cluster", F.lit(0.0).alias("distance"))
    rest = met.where("cluster IS NULL").select("id", "cf")
    return found if rest.isEmpty() else found.unionByName(nearest(rest, clusters, kind))


def farthest_pair(entries: DataFrame, kind: Distance = "d0") -> DataFrame:
    """left, right, distance of the most distant two of a node's children (at most a node's capacity plus one rows)."""
    a, b = entries.select(F.col("cluster").alias("l"), F.col("cf").alias("p")), entries.select(F.col("cluster").alias("r"), F.col("cf").alias("q"))
    d = a.join(F.broadcast(b), F.col("l") < F.col("r")).withColumn("d", distance(kind, "p", "q"))
    return d.agg(F.max(F.struct("d", -F.col("l"), -F.col("r"))).alias("m")).select((-F.col("m.col2")).alias("left"), (-F.col("m.col3")).alias("right"), F.col("m.d").alias("distance"))


def split_assignment(entries: DataFrame, kind: Distance = "d0") -> DataFrame:
    """Each child's side of a split by the farthest pair: left only if strictly nearer to its left end."""
    pair = farthest_pair(entries, kind).select("left", "right")
    ends = entries.crossJoin(F.broadcast(pair))
    l, r = entries.select(F.col("cluster").alias("left"), F.col("cf").alias("lc")), entries.select(F.col("cluster").alias("right"), F.col("cf").alias("rc"))
    d = ends.join(F.broadcast(l), "left").join(F.broadcast(r), "right")
    near = (F.col("cluster") == F.col("left")) | ((F.col("cluster") != F.col("right")) & (distance(kind, "cf", "lc") < distance(kind, "cf", "rc")))
    return d.select("cluster", F.when(near, "left").otherwise("right").alias("side"))


def can_merge(pairs: DataFrame, a: str, b: str, threshold: float, kind: Distance = "d0") -> DataFrame:
    d = distance(kind, a, b)
    return pairs.withColumn("distance", d).withColumn("merge", F.coalesce((d < threshold) & ~F.isnan(d), F.lit(False)))


def ranked_leaves(leaves: DataFrame, n: str, errors: str) -> DataFrame:
    """Leaves by promise (share of errors among all rows), the most promising first."""
    w = Window.orderBy(F.desc(F.col(errors)), "leaf")
    return leaves.withColumn("rank", F.row_number().over(w).cast("long"))
