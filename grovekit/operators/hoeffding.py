"""Hoeffding trees: ordered learning in supersteps, level-wise growth from aggregates, routing and reports.

A growing leaf depends only on the ordered rows that reach it, so all open leaves advance at once: a superstep hands each
of them its next rows (an ordinal range that grows while the leaf waits) and folds these on their own. A waiting leaf's
counts (``leaves.Leaf``: bounded histograms, and a row a text value) go from superstep to superstep, up to the last row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from . import impurity, leaves, rows


@dataclass(frozen=True)
class Config:
    """Defaults of the classic learner. max_rows: the most rows of one leaf that one superstep folds; the rest follow in later ones.

    bins: the most bins of a numeric attribute: quantiles of the table in ``grow``, of each leaf in ``learn``. laplace: votes that a leaf's
    parent has in its class. prune: ``learn`` switches off attributes and cuts that fell behind (see ``leaves``). budget: the most leaves whose
    statistics are kept at once, the most promising ones: ``grow`` counts the others later, a stream puts them to sleep.
    """

    delta: float = 1e-7
    tie: float = 0.05
    chunk: int = 300
    laplace: float = 5.0
    pre_prune: float = 0.0
    gini: bool = False
    max_depth: int | None = None
    first_span: int = 4096
    max_rows: int = 1 << 20
    bins: int = 1000
    prune: bool = True
    budget: int | None = None


@dataclass
class Node:
    """path: '' for the root, then L and R for each cut, <i> for the i-th value of a text attribute; <?> is where other values go.

    up: the parent's class when it split; before: how many of its rows then would have come here.
    """

    path: str
    attr: str | None = None
    threshold: float | None = None
    cls: int = -1
    n: int = 0
    at: int = -1
    gone: bool = False
    values: tuple[str, ...] | None = None
    n_after: int = 0
    errors: int = 0
    up: int = -1
    before: float = 0.0
    up_error: float = 0.0

    @property
    def depth(self) -> int:
        return len(_STEP.findall(self.path))

    @property
    def parent(self) -> str | None:
        return re.sub(_STEP.pattern + "$", "", self.path) if self.path else None


_STEP = re.compile("(?:[LR]|<[^>]*>)")


_impurity = leaves.impurity


def _best(tables: list[tuple[np.ndarray, np.ndarray]], gini: bool) -> tuple[list[tuple[float, int, float]], float]:
    """The two best (index, attribute, threshold) cuts and the node's own impurity; an attribute's table has its sorted values and their class counts."""
    found: list[tuple[float, int, float]] = []
    for a, (v, n) in enumerate(tables):
        live = n.any(1)
        v, below = v[live], n[live].cumsum(0)
        if len(v) < 2:
            continue
        b, rest, total = below[:-1], below[-1] - below[:-1], below[-1].sum()
        n_b = b.sum(1)
        index = (n_b * _impurity(b, gini) + (total - n_b) * _impurity(rest, gini)) / total
        if not gini and len(b) > 1:
            index = index + math.log2(len(b)) / total
        for k in np.argsort(index, kind="stable")[:2]:
            found.append((float(index[k]), a, float(v[k + 1])))
    return sorted(found)[:2], float(_impurity(tables[0][1].sum(0), gini))


def best_two(x: np.ndarray, y: np.ndarray, classes: int, gini: bool) -> tuple[list[tuple[float, int, float]], float]:
    """The two best (index, attribute, threshold) cuts of rows x with classes y, and the node's own impurity."""
    return _best([_counted(x[:, a], y, np.ones(len(y)), classes) for a in range(x.shape[1])], gini)


def _counted(v: np.ndarray, y: np.ndarray, n: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    values, code = np.unique(v, return_inverse=True)
    out = np.zeros((len(values), classes))
    np.add.at(out, (code, y), n)
    return values, out


def decide(x: np.ndarray, y: np.ndarray, classes: int, c: Config) -> tuple[str, int, float]:
    """(split | leaf | wait, attribute, threshold) of a leaf with these rows."""
    return _verdict(*best_two(x, y, classes, c.gini), x.shape[1], len(y), classes, c)


def _verdict(two: list[tuple[float, int, float]], whole: float, attributes: int, rows: int, classes: int, c: Config) -> tuple[str, int, float]:
    if not two:
        return "wait", -1, 0.0
    r = 1.0 if c.gini else math.log2(max(2, classes))
    bound = math.sqrt(r * r * math.log(attributes / c.delta) / (2 * rows))
    first, attr, threshold = two[0]
    second = two[1][0] if len(two) > 1 else whole
    if first - whole > bound or (whole - first < bound < c.pre_prune):
        return "leaf", attr, threshold
    if second - first > bound or (bound < c.tie and whole - first > c.pre_prune):
        return "split", attr, threshold
    return "wait", attr, threshold


def route(nodes: dict[str, Node], path: str = "") -> Column:
    """The leaf's path of a row as one nested expression."""
    n = nodes[path]
    if n.attr is None:
        return F.lit(path)
    if n.values is not None:
        out = F
        for i, v in enumerate(n.values):
            out = out.when(F.col(n.attr).cast("string") == v, route(nodes, f"{path}<{i}>"))
        return out.otherwise(F.lit(f"{path}<?>")) if n.values else F.lit(f"{path}<?>")
    return F.when(F.col(n.attr).cast("double") < n.threshold, route(nodes, path + "L")).otherwise(route(nodes, path + "R"))


#: Trees up to this size are routed by one nested expression, larger ones by ``_router``.
SMALL = 64


def _router(nodes: dict[str, Node], columns: list[str]):
    """Adds each row's leaf by walking the tree, a node's rows at once. The tree is a model: all of it goes to every task."""
    text = {n.attr for n in nodes.values() if n.values is not None}
    tree = {p: (n.attr, n.threshold, None if n.values is None else {v: f"{p}<{i}>" for i, v in enumerate(n.values)}) for p, n in nodes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {a: batch.column(columns.index(a)) for a in {t[0] for t in tree.values() if t[0]}}
            cols = {a: np.array(c.to_pylist(), object) if a in text else c.cast(pa.float64()).to_numpy(zero_copy_only=False) for a, c in cols.items()}
            out, todo = np.full(batch.num_rows, "", object), [("", np.arange(batch.num_rows))]
            while todo:
                p, at = todo.pop()
                attr, threshold, kids = tree.get(p, (None, None, None))
                if attr is None:
                    out[at] = p
                elif kids is None:
                    left = cols[attr][at] < threshold
                    todo += [(p + s, rows) for s, rows in (("L", at[left]), ("R", at[~left])) if len(rows)]
                else:
                    to = pd.Series(cols[attr][at]).map(kids).fillna(f"{p}<?>")
                    todo += [(k, at[rows]) for k, rows in to.groupby(to).indices.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "_leaf"])

    return run


def routed(df: DataFrame, nodes: dict[str, Node]) -> DataFrame:
    """Adds _leaf: an expression for small trees, else vectorised steps in Python; never a shuffle."""
    if len(nodes) <= SMALL:
        return df.withColumn("_leaf", route(nodes))
    return df.mapInArrow(_router(nodes, df.columns), T.StructType([*df.schema.fields, T.StructField("_leaf", T.StringType())]))


_FOLDED = "leaf string, what string, attr string, threshold double, at long, y array<double>, shares array<double>, seen array<string>, state binary"


def _folder(numeric: list[str], words: list[str], off: dict[str, frozenset], classes: int, c: Config):
    """Folds a leaf's next rows in order onto its state so far."""

    def fold(key, new, old):
        leaf = key[0]
        if len(old):
            state = leaves.Leaf.loads(old["state"].iloc[0])
        else:
            state = leaves.Leaf(numeric, [a for a in words if a not in off.get(leaf, ())], classes, c.bins)
        new = new.sort_values("_o")
        o = new["_o"].to_numpy()
        what, a, threshold, used = state.learn({x: new[x].to_numpy() for x in (*numeric, *words)}, new["_y"].to_numpy().astype(int), c)
        shares, seen = state.shares(a, threshold) if what == "split" else ([], [])
        done = what != "wait"
        row = (leaf, what, a if done else None, threshold if done else None, int(o[used - 1]) if done else -1, state.all_y().tolist(), shares, seen, None if done else state.dumps())
        return pd.DataFrame([row], columns=[f.split()[0] for f in _FOLDED.split(", ")])

    return fold


def _settled(ordered: DataFrame, nodes: dict[str, Node], new: set[str]) -> set[str]:
    """Those of these new leaves whose rows, up to the last one, have one class or none: they never decide, so counting them is all there is to do."""
    since = ordered.sparkSession.createDataFrame([(p, nodes[p].at) for p in new], "leaf string, _at long")
    rest = routed(ordered, nodes).withColumnRenamed("_leaf", "leaf").join(F.broadcast(since), "leaf").where(F.col("_o") > F.col("_at"))
    seen = {r["leaf"]: r for r in rest.groupBy("leaf").agg(F.count("*").alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi")).collect()}  # a row a new leaf
    done = {p for p in new if p not in seen or seen[p]["lo"] == seen[p]["hi"]}
    for p in done & seen.keys():
        nodes[p].n, nodes[p].cls = seen[p]["n"], seen[p]["lo"]
    return done


def learn(df: DataFrame, attributes: list[str], cls: str, order: str, classes: int, config: Config = Config()) -> dict[str, Node]:
    """Nodes of the tree of rows in the order of ``order`` (distinct integers from 0). Classes are 0 to classes - 1; rows without one are left out.

    String columns are text attributes: they split into a child for each value that came so far or comes later, at most once on a path.
    A numeric split keeps its attribute. Every leaf runs to the last row. A leaf's class has ``laplace`` votes of its parent's. A frozen leaf
    counts the rows and errors after it was frozen. A leaf's rows of one superstep are one task, ``max_rows`` at most; leaves with one class are only counted.
    """
    c, nodes = config, {"": Node("")}
    numeric, words = _kinds(df, attributes)
    off: dict[str, frozenset] = {"": frozenset()}
    ordered = df.where(F.col(cls).isNotNull()).select(F.col(order).cast("long").alias("_o"), F.col(cls).cast("int").alias("_y"), *[F.col(a).cast("double").alias(a) for a in numeric], *words)
    last = df.agg(F.max(F.col(order).cast("long"))).first()[0]
    if last is None:
        return nodes
    spark, total = df.sparkSession, last + 1
    span, seen = {"": c.first_span}, {"": -1}  # of open leaves: next span, last ordinal
    held = spark.createDataFrame([], "leaf string, state binary")
    opened = {""}
    while span:
        if opened:
            for p in (done := _settled(ordered, nodes, opened)):
                n = nodes[p]
                n.cls = leaves.vote(np.bincount([n.cls], [n.n], classes) if n.n else np.zeros(classes), n.up, c.laplace)
                del span[p], seen[p]
            opened = set()
            if done:
                continue
        stop = {p: min(seen[p] + span[p], total - 1) for p in span}
        ranges = spark.createDataFrame([(p, seen[p], stop[p]) for p in span], "leaf string, _lo long, _hi long")
        part = routed(ordered.where((F.col("_o") > min(seen.values())) & (F.col("_o") <= max(stop.values()))), nodes).withColumnRenamed("_leaf", "leaf")
        part = part.join(F.broadcast(ranges), "leaf").where((F.col("_o") > F.col("_lo")) & (F.col("_o") <= F.col("_hi")))  # a row an open leaf
        large: set[str] = set()
        if max(span.values()) > c.max_rows:  # so many ordinals have as many rows at most
            large = {r["leaf"] for r in part.groupBy("leaf").count().where(F.col("count") > c.max_rows).collect()}
        turn = spark.createDataFrame([(p,) for p in span if p not in large] or [(None,)], "leaf string")
        mine = lambda t: t.join(F.broadcast(turn), "leaf", "left_semi").groupBy("leaf")
        folded = cut(mine(part).cogroup(mine(held)).applyInPandas(_folder(numeric, words, off, classes, c), _FOLDED))
        got = {r["leaf"]: r for r in folded.drop("state").collect()}  # a row a leaf
        texts: dict[str, str] = {}
        closed, fresh = [], []
        for p in list(span):
            n = nodes[p]
            if p in large:
                span[p] = max(c.max_rows, span[p] // 8)
                continue
            r = got.get(p)
            y = np.array(r["y"]) if r else np.zeros(classes)
            n.n, n.cls = int(y.sum()), leaves.vote(y, n.up, c.laplace)
            if r is None or r["what"] == "wait":
                seen[p], span[p] = stop[p], span[p] * 8
                if stop[p] == total - 1:
                    closed.append(p)
                continue
            closed.append(p)
            n.at = r["at"]
            if r["what"] != "split" or (c.max_depth is not None and n.depth >= c.max_depth):
                n.gone = True
                continue
            n.attr, n.threshold, top = r["attr"], r["threshold"], int(y.argmax())
            if n.threshold is None:
                texts[p], n.values = n.attr, tuple(r["seen"])
            kids = [p + "L", p + "R"] if n.threshold is not None else [f"{p}<{i}>" for i in range(len(n.values))]
            fresh += [(k, p, top, s * (n.n + n.before)) for k, s in zip(kids, r["shares"], strict=True)]
        if texts:  # values that come only after the split have children too, which begin to grow then
            came = ordered.where(F.col("_o") > min(nodes[p].at for p in texts))
            which = spark.createDataFrame([(p, a, nodes[p].at) for p, a in texts.items()], "leaf string, _a string, _at long")
            before = {**nodes, **{p: Node(p) for p in texts}}
            came = routed(came, before).withColumnRenamed("_leaf", "leaf").join(F.broadcast(which), "leaf").where(F.col("_o") > F.col("_at"))
            value = F.create_map(*[x for a in words for x in (F.lit(a), F.col(a))])[F.col("_a")]
            later: dict[str, set[str]] = {}
            for r in came.select("leaf", value.alias("v")).where("v IS NOT NULL").distinct().collect():  # the children
                later.setdefault(r["leaf"], set()).add(r["v"])
            for p in texts:
                n = nodes[p]
                new = sorted(later.get(p, set()) - set(n.values))
                fresh += [(f"{p}<{len(n.values) + i}>", p, next(f[2] for f in fresh if f[1] == p), 0.0) for i in range(len(new))]
                n.values = (*n.values, *new)
        for k, p, top, share in fresh:
            nodes[k] = Node(k, at=nodes[p].at, up=top, cls=top, before=float(int(share)))
            off[k] = off[p] | {nodes[p].attr} if nodes[p].values is not None else off[p]
            span[k], seen[k] = c.first_span, nodes[p].at
            opened.add(k)
        for p in closed:
            del span[p], seen[p]
        stay = spark.createDataFrame([(p,) for p in span] or [(None,)], "leaf string")
        kept = folded.where("state IS NOT NULL").select("leaf", "state")
        if large:
            kept = kept.unionByName(held.join(F.broadcast(spark.createDataFrame([(p,) for p in large], "leaf string")), "leaf", "left_semi"))
        held = kept.join(F.broadcast(stay), "leaf", "left_semi")
        for p in [p for p in span if seen[p] >= total - 1]:  # split at the very last row
            nodes[p].cls = nodes[p].up
            opened.discard(p)
            del span[p], seen[p]
    frozen = [p for p, n in nodes.items() if n.gone]
    if frozen:
        since = spark.createDataFrame([(p, nodes[p].at) for p in frozen], "leaf string, _at long")
        after = routed(ordered, nodes).withColumnRenamed("_leaf", "leaf").join(F.broadcast(since), "leaf").where(F.col("_o") > F.col("_at"))
        for r in after.groupBy("leaf", "_y").count().collect():  # leaves x classes
            nodes[r["leaf"]].n_after += r["count"]
            nodes[r["leaf"]].errors += r["count"] * (r["_y"] != nodes[r["leaf"]].cls)
    return nodes


def bin_edges(df: DataFrame, names: list[str], most: int, given: dict[str, list[float]] | None = None) -> dict[str, list[float]]:
    """Where each numeric attribute is cut: at its distinct values, or if it has more than ``most``, where ``most`` equal shares of its rows begin.

    Exact: one aggregate to distinct values, then running sums of each attribute's values in ranges; the driver gets at most ``most`` edges an attribute.
    """
    edges = dict(given or {})
    names = [a for a in names if a not in edges]
    if not names:
        return edges
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("double").alias("v")) for a in names])
    values = df.select(F.explode(pairs).alias("p")).where(F.col("p.v").isNotNull() & ~F.isnan("p.v")).groupBy("p.a", "p.v").agg(F.count("*").alias("n"))
    values = cut(values)
    size = {r["a"]: r for r in values.groupBy("a").agg(F.count("*").alias("values"), F.sum("n").alias("rows")).collect()}
    few = [a for a in size if size[a]["values"] <= most]
    found: dict[str, list[float]] = {a: [] for a in names}
    for r in values.where(F.col("a").isin(few)).collect() if few else []:  # at most `most` an attribute
        found[r["a"]].append(r["v"])
    for a in size:
        if a not in few:
            run = rows.with_running(values.where(F.col("a") == a).select("v", "n"), ["v"], F.col("n"))
            share = F.floor((F.col("_sum") - F.col("n")) * most / size[a]["rows"])
            found[a] = [r["v"] for r in run.groupBy(share.alias("s")).agg(F.min("v").alias("v")).collect()]
    return edges | {a: sorted(v)[1:] for a, v in found.items()}


def binned(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Adds _b0, _b1, ...: the bin of each attribute, which holds its lower edge. Null and NaN are in the last one, as routing sends them right."""
    from pyspark.ml.feature import Bucketizer

    out = df
    for i, (a, e) in enumerate(edges.items()):
        x = F.col(a).cast("double")
        out = out.withColumn(f"_x{i}", F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(x)) if e else out.withColumn(f"_b{i}", F.lit(0))
    cut_at = {i: [float("-inf"), *map(float, e), float("inf")] for i, e in enumerate(edges.values()) if e}
    if cut_at:
        out = Bucketizer(splitsArray=list(cut_at.values()), inputCols=[f"_x{i}" for i in cut_at], outputCols=[f"_b{i}" for i in cut_at]).transform(out)
    return out.withColumns({f"_b{i}": F.col(f"_b{i}").cast("int") for i in cut_at}).drop(*[f"_x{i}" for i in cut_at])


def level_counts(routed: DataFrame, edges: dict[str, list[float]], words: list[str], cls: str, classes: int) -> DataFrame:
    """leaf, attr, bin (numeric) or value (text), and a count for each class: one aggregate, at most as many rows as leaves x bins of all attributes."""
    pairs = [F.struct(F.lit(a).alias("attr"), F.col(f"_b{i}").alias("bin"), F.lit(None).cast("string").alias("value")) for i, a in enumerate(edges)]
    pairs += [F.struct(F.lit(a).alias("attr"), F.lit(None).cast("int").alias("bin"), F.col(a).alias("value")) for a in words]
    long = routed.select("_leaf", F.col(cls).alias("_y"), F.explode(F.array(*pairs)).alias("p"))
    return long.groupBy(F.col("_leaf").alias("leaf"), "p.attr", "p.bin", "p.value").agg(*[F.count_if(F.col("_y") == k).alias(f"c{k}") for k in range(classes)])


def _kinds(df: DataFrame, attributes: list[str]) -> tuple[list[str], list[str]]:
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [a for a in attributes if a not in text], [a for a in attributes if a in text]


def grow(df: DataFrame, attributes: list[str], cls: str, classes: int, config: Config = Config(), edges: dict[str, list[float]] | None = None) -> dict[str, Node]:
    """Level-wise growth over the whole table. A level is one aggregate of (leaf, attribute, bin or value, class) counts.

    Text attributes split into one child a value, at most once on a path; an empty leaf has its parent's class. ``edges`` gives bins of some
    attributes; the others' come from ``bin_edges``.
    """
    c, nodes, open_, off = config, {"": Node("")}, [""], {"": frozenset()}
    numeric, words = _kinds(df, attributes)
    edges = bin_edges(df, numeric, c.bins, edges)
    edges = {a: edges[a] for a in numeric}
    data, spark = binned(df.select(*attributes, cls), edges), df.sparkSession
    r = 1.0 if c.gini else math.log2(max(2, classes))
    queue = open_
    while queue:
        queue.sort(key=lambda p: -nodes[p].before * nodes[p].up_error)  # stable: without a budget all are taken
        open_, queue = queue[: c.budget], queue[c.budget :] if c.budget else []
        here = F.broadcast(spark.createDataFrame([(p,) for p in open_], "_leaf string"))  # the model's open leaves
        counts = cut(level_counts(routed(data, nodes).join(here, "_leaf", "left_semi"), edges, words, cls, classes))
        total = {t["leaf"]: np.array([t[f"c{k}"] for k in range(classes)], float) for t in counts.where(F.col("attr") == attributes[0]).groupBy("leaf").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)]).collect()}  # leaves
        found = impurity.bin_cuts(counts.where("bin IS NOT NULL"), classes, c.gini).unionByName(impurity.value_index(counts.where("bin IS NULL AND value IS NOT NULL"), classes, c.gini))
        used = [(p, a) for p in open_ for a in sorted(off[p])]
        if used:
            found = found.join(F.broadcast(spark.createDataFrame(used, "leaf string, attr string")), ["leaf", "attr"], "left_anti")
        first = F.row_number().over(Window.partitionBy("leaf").orderBy("index", "attr", "bin"))
        best: dict[str, list[tuple[float, str, int | None]]] = {p: [] for p in open_}
        for k in found.withColumn("_r", first).where("_r <= 2").collect():  # two a leaf
            best[k["leaf"]].append((k["index"], k["attr"], k["bin"]))
        split: list[str] = []
        errors: dict[str, float] = {}
        for p in open_:
            n, y, two = nodes[p], total.get(p, np.zeros(classes)), sorted(best[p], key=lambda b: b[:2])
            n.up = nodes[n.parent].cls if n.parent is not None else -1
            error = 1 - y.max() / y.sum() if y.sum() else 0.0
            n.n, n.cls = int(y.sum()), int(y.argmax()) if y.sum() else n.up
            if not two or (c.max_depth is not None and n.depth >= c.max_depth) or (y > 0).sum() < 2:
                continue
            whole = float(_impurity(y, c.gini))
            second = two[1][0] if len(two) > 1 else whole
            bound = math.sqrt(r * r * math.log((len(attributes) - len(off[p])) / c.delta) / (2 * n.n))
            if whole - two[0][0] > c.pre_prune and (second - two[0][0] > bound or bound < c.tie):
                _, n.attr, at = two[0]
                n.threshold = None if at is None else float(edges[n.attr][at - 1])
                split.append(p)
                errors[p] = error
        seen: dict[str, list[str]] = {}
        chosen = [(p, nodes[p].attr) for p in split if nodes[p].threshold is None]
        if chosen:
            mine = F.broadcast(spark.createDataFrame(chosen, "leaf string, attr string"))
            for v in counts.where(F.col("value").isNotNull()).join(mine, ["leaf", "attr"], "left_semi").select("leaf", "value").distinct().collect():  # the children
                seen.setdefault(v["leaf"], []).append(v["value"])
        for p in split:
            n = nodes[p]
            if n.threshold is None:
                n.values = tuple(sorted(seen.get(p, [])))
            kids = [f"{p}<{i}>" for i in range(len(n.values))] if n.values is not None else [p + "L", p + "R"]
            for k in kids:
                nodes[k], off[k] = Node(k, before=float(n.n), up_error=errors[p]), off[p] | {n.attr} if n.values is not None else off[p]
            queue += kids
    return nodes


def _added(numeric: list[str], words: list[str], off: dict[str, frozenset], classes: int, bins: int):
    """One replica's counts of its rows of a leaf."""

    def add(key, new):
        f = leaves.Leaf(numeric, [a for a in words if a not in off.get(key[0], ())], classes, bins)
        f.add({a: new[a].to_numpy() for a in (*numeric, *words)}, new["_y"].to_numpy().astype(int))
        return pd.DataFrame([(key[0], int(key[1]), f.dumps())], columns=["leaf", "replica", "state"])

    return add


def _exchanged_or_kept(c: Config, checked: dict[str, int]):
    """All replicas' counts of a leaf join what was exchanged before; with a chunk of new rows the leaf decides."""

    def meet(key, new, old):
        parts = [leaves.Leaf.loads(b) for b in new.sort_values("replica")["state"]] if len(new) else []
        state = leaves.Leaf.loads(old["state"].iloc[0]) if len(old) else parts.pop(0)
        for f in parts:
            state.merge(f)
        what, a, threshold = "wait", None, None
        ready = state.n - checked.get(key[0], 0) >= c.chunk
        if ready and (state.y > 0).sum() > 1:
            what, a, threshold = state.decide(c)
        shares, seen = state.shares(a, threshold) if what == "split" else ([], [])
        done = what != "wait"
        row = (key[0], what, a if done else None, threshold if done else None, state.n if ready else -1, state.y.tolist(), shares, seen, None if done else state.dumps())
        return pd.DataFrame([row], columns=[f.split()[0] for f in _FOLDED.split(", ")])

    return meet


def learn_replicas(df: DataFrame, attributes: list[str], cls: str, order: str, classes: int, replicas: int, config: Config = Config(), window: int = 1 << 16) -> dict[str, Node]:
    """Nodes of the tree that ``replicas`` models learn together, each from its share of the rows (dealt by their number).

    Per window of ordinals every replica counts its rows of each open leaf on its own, so one leaf's rows take many tasks; then the
    replicas' statistics are exchanged, and a leaf that has a chunk of new rows decides once for all of them. Rows of a window stay with the
    leaves that were open at its beginning. The tree is that of one replica as long as attributes have at most ``bins`` values; beyond, cuts
    may be off by the histograms' ``error``. Values of a text attribute that come after its split predict as their parent.
    """
    c, nodes, spark = config, {"": Node("")}, df.sparkSession
    numeric, words = _kinds(df, attributes)
    off: dict[str, frozenset] = {"": frozenset()}
    ordered = df.where(F.col(cls).isNotNull()).select(F.col(order).cast("long").alias("_o"), F.col(cls).cast("int").alias("_y"), *[F.col(a).cast("double").alias(a) for a in numeric], *words)
    last = ordered.agg(F.max("_o")).first()[0]
    held, checked, open_, new = spark.createDataFrame([], "leaf string, state binary"), {"": 0}, {""}, {""}
    for a in range(0, -1 if last is None else last + 1, window):
        if new:
            for p in _settled(ordered, nodes, new):
                n = nodes[p]
                if n.n:
                    n.cls = leaves.vote(np.bincount([n.cls], [n.n], classes), n.up, c.laplace)
                open_.discard(p)
            new = set()
        if not open_:
            break
        here = F.broadcast(spark.createDataFrame([(p,) for p in open_], "_leaf string"))  # the model's open leaves
        part = routed(ordered.where(F.col("_o").between(a, a + window - 1)), nodes).join(here, "_leaf", "left_semi").withColumnRenamed("_leaf", "leaf")
        counted = part.groupBy("leaf", F.pmod("_o", F.lit(replicas)).alias("replica")).applyInPandas(_added(numeric, words, off, classes, c.bins), "leaf string, replica int, state binary")
        came = counted.groupBy("leaf").cogroup(held.groupBy("leaf")).applyInPandas(_exchanged_or_kept(c, dict(checked)), _FOLDED)
        met = cut(came)
        for r in met.drop("state").collect():  # a row an open leaf
            p, y = r["leaf"], np.array(r["y"])
            n = nodes[p]
            n.n, n.cls = int(y.sum()), leaves.vote(y, n.up, c.laplace)
            if r["at"] >= 0:
                checked[p] = r["at"]
            if r["what"] == "wait":
                continue
            open_.discard(p)
            n.at = min(a + window - 1, last)
            if r["what"] != "split" or (c.max_depth is not None and n.depth >= c.max_depth):
                n.gone = True
                continue
            n.attr, n.threshold = r["attr"], r["threshold"]
            n.values = None if n.threshold is not None else tuple(r["seen"])
            kids = [p + "L", p + "R"] if n.threshold is not None else [f"{p}<{i}>" for i in range(len(n.values))]
            for k, s in zip(kids, r["shares"], strict=True):
                nodes[k] = Node(k, at=n.at, up=int(y.argmax()), cls=int(y.argmax()), before=float(int(s * (n.n + n.before))), up_error=1 - y.max() / y.sum())
                off[k] = off[p] | {n.attr} if n.values is not None else off[p]
                open_.add(k)
                new.add(k)
        held = met.where("state IS NOT NULL").select("leaf", "state")
    return nodes


def classify(df: DataFrame, nodes: dict[str, Node]) -> DataFrame:
    """Adds leaf and pred; a leaf without rows and a value that was never seen predict as their parent. No shuffle; for small trees only an expression."""
    known = [(p, n.cls) for p, n in nodes.items() if n.attr is None] + [(f"{p}<?>", n.cls) for p, n in nodes.items() if n.values is not None]
    out = routed(df, nodes).withColumnRenamed("_leaf", "leaf")
    if len(known) > SMALL:
        return out.join(F.broadcast(df.sparkSession.createDataFrame(known, "leaf string, pred int")), "leaf", "left").select(*df.columns, "leaf", "pred")  # a model's leaves
    by = F.create_map(*[F.lit(v) for pair in known for v in pair])
    return out.withColumn("pred", by[F.col("leaf")].cast("int"))


def table(df: DataFrame, nodes: dict[str, Node]) -> DataFrame:
    """The node table: node, parent, depth, kind, attr, threshold, cls, n."""
    rows = [(p, n.parent, n.depth, "split" if n.attr else "leaf" if n.gone else "growing", n.attr, n.threshold, n.cls, n.n) for p, n in sorted(nodes.items())]
    return df.sparkSession.createDataFrame(rows, "node string, parent string, depth int, kind string, attr string, threshold double, cls int, n long")


def merged_counts(parts: list[DataFrame], attributes: list[str], cls: str) -> DataFrame:
    """Leaf statistics of replicas added up: each task of each replica counts its own rows, and one aggregate sums all of these."""
    out = impurity.melt(parts[0], attributes, cls)
    for p in parts[1:]:
        out = out.unionByName(impurity.melt(p, attributes, cls))
    return out.groupBy("attr", "value", "cls").agg(F.count("*").alias("n"))
