"""Split statistics of a Hoeffding tree's leaves as aggregates and windows over one long (leaf, attribute, value, class) table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def lg(c: Column) -> Column:
    return F.log(c) / F.lit(math.log(2))


def melt(df: DataFrame, attributes: list[str], cls: str) -> DataFrame:
    """attr, value (double), cls: one row per attribute of each row."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("value")) for a in attributes])
    return df.select(F.explode(pairs).alias("p"), F.col(cls).alias("cls")).select("p.attr", "p.value", "cls")


def class_totals(df: DataFrame, cls: str, leaf: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(leaf or []), F.col(cls).alias("cls")).agg(F.count("*").alias("n"))


def node_impurity(df: DataFrame, cls: str) -> DataFrame:
    """n, gini and entropy of one node; an empty node has 1 and lg(classes) = null."""
    t = class_totals(df, cls)
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return t.withColumn("p", p).agg(F.sum("n").alias("n"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), (-F.sum(F.col("p") * lg(F.col("p")))).alias("entropy"))


def discrete_counts(df: DataFrame, attributes: list[str], cls: str) -> DataFrame:
    """attr, value (text), cls, n."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes])
    return df.select(F.explode(pairs).alias("p"), F.col(cls).alias("cls")).groupBy("p.attr", "p.value", "cls").agg(F.count("*").alias("n"))


def discrete_index(counts: DataFrame) -> DataFrame:
    """gini and entropy of splitting on each discrete attribute, from ``discrete_counts``."""
    value = Window.partitionBy("attr", "value")
    p = F.col("n") / F.sum("n").over(value)
    parts = counts.withColumn("p", p).groupBy("attr", "value").agg(F.sum("n").alias("nv"), (1 - F.sum(F.col("p") * F.col("p"))).alias("g"), (-F.sum(F.col("p") * lg(F.col("p")))).alias("e"))
    whole = F.sum("nv").over(Window.partitionBy("attr"))
    return parts.withColumn("w", F.col("nv") / whole).groupBy("attr").agg(F.sum(F.col("w") * F.col("g")).alias("gini"), F.sum(F.col("w") * F.col("e")).alias("entropy"))


def cuts(df: DataFrame, attributes: list[str], cls: str, classes: list | None = None, leaf: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """attr, value, below_n, above_n, gini, entropy and cuts (their number) for each cut after an attribute's value but the last, per leaf.

    One aggregate gives a row per distinct value with a count for each class. Prefix sums run within ranges of an attribute's
    values (its approximate quantiles), and only the ranges' totals are added up beside them, so no attribute is one task.
    """
    spark, key = df.sparkSession, [*(leaf or []), "attr"]
    if classes is None:
        classes = sorted(r[0] for r in df.select(cls).distinct().collect() if r[0] is not None)  # a label's domain
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)] or [F.lit(1.0)])
    got = df.agg(*[F.percentile_approx(F.col(a).cast("double"), at, 1000).alias(a) for a in attributes]).first()
    bounds = F.create_map(*[x for a in attributes for x in (F.lit(a), F.array(*[F.lit(float(v)) for v in sorted(set(got[a] or []))]).cast("array<double>"))])
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("value")) for a in attributes])
    long = df.select(*(leaf or []), F.col(cls).alias("_y"), F.explode(pairs).alias("p")).select(*(leaf or []), "_y", "p.attr", "p.value")
    names = [f"_c{i}" for i in range(len(classes))]
    wide = long.groupBy(*key, "value").agg(*[F.count_if(F.col("_y") == k).alias(c) for c, k in zip(names, classes, strict=True)])
    wide = cut(wide.withColumn("_part", F.size(F.filter(bounds[F.col("attr")], lambda v: v < F.col("value")))))  # read twice below
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    totals = wide.groupBy(*key, "_part").agg(F.count("*").alias("_v"), *[F.sum(c).alias(c) for c in names])
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*key, "_part"])], F.sum("_v").over(whole).alias("_values"), *[x for c in names for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0"), F.sum(c).over(whole).alias(f"{c}_t"))])
    same = F.lit(True)
    for i, k in enumerate([*key, "_part"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    run = Window.partitionBy(*key, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    c = wide.join(F.broadcast(totals) if not leaf else totals, same)  # at most attributes x ranges rows without leaves
    below = [F.col(f"{x}_0") + F.sum(x).over(run) for x in names]
    c = c.select(*key, "value", "_values", *[b.alias(f"_b{i}") for i, b in enumerate(below)], *[F.col(f"{x}_t").alias(f"_t{i}") for i, x in enumerate(names)])
    b = [F.col(f"_b{i}").cast("double") for i in range(len(names))]
    a = [(F.col(f"_t{i}") - F.col(f"_b{i}")).cast("double") for i in range(len(names))]
    add = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0.0)
    nb, na = add(b), add(a)
    gini = lambda xs, m: 1 - add([F.pow(x / m, 2) for x in xs])
    entropy = lambda xs, m: add([F.when(x > 0, -(x / m) * lg(x / m)).otherwise(0.0) for x in xs])
    mixed = lambda f: nb / (nb + na) * f(b, F.nullif(nb, F.lit(0.0))) + na / (nb + na) * f(a, F.nullif(na, F.lit(0.0)))
    return c.where((na > 0) & (nb > 0)).select(*key, "value", nb.cast("long").alias("below_n"), na.cast("long").alias("above_n"), mixed(gini).alias("gini"), mixed(entropy).alias("entropy"), (F.col("_values") - 1).alias("cuts"))


def _weighted(parts: list[list[Column]], gini: bool) -> Column:
    """Impurity of class counts in several parts, weighted by their sizes."""
    total = lambda xs: sum(xs[1:], xs[0])
    out = []
    for xs in parts:
        m = F.nullif(total(xs), F.lit(0.0))
        one = F.lit(1.0) - total([F.pow(x / m, 2) for x in xs]) if gini else total([F.when(x > 0, -(x / m) * lg(F.when(x > 0, x) / m)).otherwise(0.0) for x in xs])
        out.append(total(xs) * F.coalesce(one, F.lit(0.0)))
    return total(out) / total([total(xs) for xs in parts])


def bin_cuts(counts: DataFrame, classes: int, gini: bool = False) -> DataFrame:
    """leaf, attr, bin, index of each cut below a bin, from leaf, attr, bin, c0, c1, ...; entropy has the description length added.

    A leaf's attribute has at most as many rows as bins, so its window is small.
    """
    part = Window.partitionBy("leaf", "attr")
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"c{k}" for k in range(classes)]
    w = counts.select("leaf", "attr", "bin", F.lead("bin").over(part.orderBy("bin")).alias("next"), F.count("*").over(part).alias("bins"), *[F.sum(c).over(run).cast("double").alias(f"b{c}") for c in names], *[F.sum(c).over(part).cast("double").alias(f"t{c}") for c in names])
    below, above = [F.col(f"b{c}") for c in names], [F.col(f"t{c}") - F.col(f"b{c}") for c in names]
    n = sum([F.col(f"t{c}") for c in names][1:], F.col("tc0"))
    index = _weighted([below, above], gini)
    if not gini:
        index = index + F.when(F.col("bins") > 2, lg((F.col("bins") - 1).cast("double")) / n).otherwise(0.0)
    return w.where("next IS NOT NULL").select("leaf", "attr", F.col("next").alias("bin"), index.alias("index"))


def value_index(counts: DataFrame, classes: int, gini: bool = False) -> DataFrame:
    """leaf, attr, bin (null), index of a split into one child a value, from leaf, attr, value, c0, c1, ...; attributes with two values at least."""
    xs = [F.col(f"c{k}").cast("double") for k in range(classes)]
    n = sum(xs[1:], xs[0])
    each = counts.select("leaf", "attr", n.alias("n"), (n * _weighted([xs], gini)).alias("w"))
    return each.groupBy("leaf", "attr").agg(F.count("*").alias("values"), (F.sum("w") / F.sum("n")).alias("index")).where("values > 1").select("leaf", "attr", F.lit(None).cast("int").alias("bin"), "index")


def percent_below(bins: DataFrame, threshold: float) -> DataFrame:
    """Share of rows below a threshold, from bins (lower, upper, n): whole bins below it, and its own bin's share by linear interpolation."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(threshold)) - F.col("lower")) / F.nullif(F.col("upper") - F.col("lower"), F.lit(0.0))))
    share = F.when(F.col("upper") <= threshold, F.lit(1.0)).otherwise(F.coalesce(inside, F.lit(0.0)))
    return bins.agg((F.sum(F.col("n") * share) / F.sum("n")).alias("percent"))


def prune_bins(bins: DataFrame, index: str, limit: float) -> DataFrame:
    """Bins (bin, n and a count for each class) whose cut above is worse than ``limit`` join their right neighbour: their counts add up, the last bin's name stays."""
    w = Window.orderBy(F.desc("bin"))  # a leaf's bins, at most a thousand
    kept = bins.withColumn("_own", F.when((F.col(index) <= limit) | F.col(index).isNull(), F.col("bin")))
    named = kept.withColumn("bin", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = [c for c in bins.columns if c not in ("bin", index)]
    return named.groupBy("bin").agg(*[F.sum(c).alias(c) for c in sums])


def with_mdl(c: DataFrame) -> DataFrame:
    """Adds index: entropy and the description length lg(cuts) / n of choosing a cut (0 for one); takes cuts off."""
    n = F.col("below_n") + F.col("above_n")
    return c.withColumn("index", F.col("entropy") + F.when(F.col("cuts") > 1, lg(F.col("cuts").cast("double")) / n).otherwise(0.0)).drop("cuts")


def best_cuts(c: DataFrame, index: str = "index", k: int = 2) -> DataFrame:
    """The best k cuts over all attributes; both may be of one attribute. A top-k, not a sort."""
    return c.orderBy(index, "attr", "value").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(index, "attr", "value")).cast("long"))


def hoeffding_bound(n: Column, delta: float, attributes: int, value_range: float) -> Column:
    """sqrt(R^2 ln(1 / (delta / attributes)) / 2n)."""
    return F.sqrt(F.lit(value_range**2 * math.log(attributes / delta)) / (2 * n))


def decision(best: DataFrame, node: DataFrame, attributes: int, classes: int, delta: float = 1e-7, tie: float = 0.05) -> DataFrame:
    """The split decision of a leaf from its best two cuts and its own entropy: split, tie, leaf or wait."""
    r = math.log2(max(2, classes))
    two = best.agg(F.max(F.when(F.col("rank") == 1, F.struct("attr", "value", "index"))).alias("f"), F.max(F.when(F.col("rank") == 2, F.col("index"))).alias("second"))
    d = two.crossJoin(F.broadcast(node)).select(F.col("f.attr").alias("attr"), F.col("f.value").alias("threshold"), F.col("f.index").alias("first"), "second", F.col("entropy").alias("null_index"), hoeffding_bound(F.col("n"), delta, attributes, r).alias("bound"))
    gap = F.col("second") - F.col("first")
    return d.withColumn("decision", F.when(F.col("first") - F.col("null_index") > F.col("bound"), "leaf").when(gap > F.col("bound"), "split").when((F.col("bound") < tie) & (F.col("null_index") > F.col("first")), "tie").otherwise("wait"))


def laplace_majority(df: DataFrame, leaf: str, cls: str, parent: int, laplace: float) -> DataFrame:
    """Each leaf's class: the largest count, the parent's class raised by ``laplace``; ties go to the lower class."""
    t = class_totals(df, cls, [leaf]).withColumn("w", F.col("n") + F.when(F.col("cls") == parent, laplace).otherwise(0.0))
    return t.groupBy(leaf).agg(F.max_by("cls", F.struct("w", -F.col("cls"))).alias("majority"), F.sum("n").alias("n"), (1 - F.max_by("n", F.struct("w", -F.col("cls"))) / F.sum("n")).alias("error_rate"))
