"""Structured Streaming: continuous counts and clustering features, and models that follow a stream in micro-batches."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import birch, hoeffding, leaves, upkeep


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a table, one file or a folder of them."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    return r.parquet(path) if is_dir else r.option("pathGlobFilter", name).parquet(folder)


def run_once(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs an aggregating plan over all there is (AvailableNow) and returns its final rows."""
    name = f"t{uuid.uuid4().hex}"
    q = plan(source(spark, path)).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


class Snapshots:
    """Versions of a model in the shared folder, one a batch: a model is restored from its last one, and a batch that has one counts no more.

    A version is there once its writing has succeeded. Streaming delivers a batch again if the driver ended before its commit; its
    version then says whether it had been counted.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hpath("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hpath(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._hpath("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._hpath(""))]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._hpath(f"{n}/_SUCCESS")))

    def load(self) -> tuple[int, dict]:
        """The last batch counted and the model after it; -1 and nothing before the first."""
        known = self.versions()
        return (known[-1], pickle.loads(self.spark.read.parquet(f"{self.path}/{known[-1]}").first()["state"])) if known else (-1, {})

    def save(self, batch: int, state: dict) -> None:
        self.spark.createDataFrame([(bytearray(pickle.dumps(state)),)], "state binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{batch}")
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self._hpath(str(old)), True)


class _Following:
    """What models that follow a stream share: each batch counts once, and with ``path`` they go on where their last version ended."""

    STATE: tuple[str, ...] = ()

    def _open(self, path: str | None, spark: SparkSession | None) -> None:
        self.batch, self.snapshots = -1, None
        if path:
            self.snapshots = Snapshots(spark or SparkSession.active(), path)
            self.batch, state = self.snapshots.load()
            self.__dict__.update(state)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: ids that rise; one that was counted changes nothing."""
        if batch_id <= self.batch:
            return
        self._count(batch)
        if self.snapshots:
            self.snapshots.save(batch_id, {k: getattr(self, k) for k in self.STATE})
        self.batch = batch_id


class StreamingTree(_Following):
    """A Hoeffding tree that grows with every micro-batch. Status is a query away.

    Bins come from the first batch. Each batch adds one aggregate of (leaf, attribute, bin or value, class) counts to the open leaves'
    own, which are part of the model; leaves that may split do, and the same batch is counted again for their children only.
    """

    def __init__(self, attributes: list[str], cls: str, classes: int, config: hoeffding.Config = hoeffding.Config(), path: str | None = None, spark: SparkSession | None = None):
        self.attributes, self.cls, self.classes, self.config = attributes, cls, classes, config
        self.nodes: dict[str, hoeffding.Node] = {"": hoeffding.Node("")}
        self.counts: dict[str, dict[str, dict]] = {"": {}}
        self.off: dict[str, frozenset] = {"": frozenset()}
        self.edges: dict[str, list[float]] | None = None
        self.rows = 0
        self.asleep: dict[str, np.ndarray] = {}
        self.earlier: dict[str, np.ndarray] = {}
        self._open(path, spark)

    STATE = ("nodes", "counts", "off", "edges", "rows", "asleep", "earlier")

    def _count(self, batch: DataFrame) -> None:
        numeric, words = hoeffding._kinds(batch, self.attributes)
        if self.edges is None:
            found = hoeffding.bin_edges(batch, numeric, self.config.bins)
            self.edges = {a: found[a] for a in numeric}
        rows, fresh = hoeffding.binned(batch.select(*self.attributes, self.cls), self.edges), None
        self._open_values(rows)
        if self.asleep:  # class counts only
            there = F.broadcast(batch.sparkSession.createDataFrame([(p,) for p in self.asleep], "_leaf string"))
            for r in hoeffding.routed(rows, self.nodes).join(there, "_leaf", "left_semi").groupBy("_leaf", self.cls).count().collect():  # leaves x classes
                if r[self.cls] is not None:
                    self.asleep[r["_leaf"]][r[self.cls]] += r["count"]
                    self.rows += r["count"]
            for p, y in self.asleep.items():
                self.nodes[p].n, self.nodes[p].cls = int(y.sum()), int(y.argmax()) if y.any() else self.nodes[p].cls
        while fresh is None or fresh:
            routed = hoeffding.routed(rows, self.nodes)
            if fresh is not None or self.asleep:
                awake = self.counts if fresh is None else fresh
                routed = routed.join(F.broadcast(batch.sparkSession.createDataFrame([(p,) for p in awake], "_leaf string")), "_leaf", "left_semi")
            added: dict[str, int] = {}
            for r in hoeffding.level_counts(routed, self.edges, words, self.cls, self.classes).collect():  # leaves x bins
                if r["leaf"] in self.counts:
                    n = np.array([r[f"c{k}"] for k in range(self.classes)])
                    mine = self.counts[r["leaf"]].setdefault(r["attr"], {})
                    key = r["value"] if r["bin"] is None else r["bin"]
                    mine[key] = mine.get(key, 0) + n
                    if r["attr"] == self.attributes[0]:
                        added[r["leaf"]] = added.get(r["leaf"], 0) + int(n.sum())
            self.rows += sum(added.values()) if fresh is None else 0
            fresh = [k for p in added for k in self._decide(p)]
        self._rank()

    def _open_values(self, rows: DataFrame) -> None:
        """Values of text attributes that come only after their split get children, which begin to grow now."""
        split = [(f"{p}<?>", n.attr) for p, n in self.nodes.items() if n.values is not None]
        if not split:
            return
        names = sorted({a for _, a in split})
        there = F.broadcast(rows.sparkSession.createDataFrame(split, "_leaf string, _a string"))
        value = F.create_map(*[x for a in names for x in (F.lit(a), F.col(a))])[F.col("_a")]
        new = hoeffding.routed(rows, self.nodes).where(F.col("_leaf").endswith("<?>")).join(there, "_leaf").select("_leaf", value.alias("v")).where("v IS NOT NULL").distinct()
        for r in sorted(map(tuple, new.collect())):  # the children
            p = r[0][: -len("<?>")]
            n = self.nodes[p]
            k = f"{p}<{len(n.values)}>"
            n.values = (*n.values, r[1])
            self.nodes[k], self.counts[k], self.off[k] = hoeffding.Node(k, cls=n.cls, up=n.cls), {}, self.off[p] | {n.attr}

    def _rank(self) -> None:
        """Of more growing leaves than the budget has, the least promising sleep: their statistics go and only classes are counted. They wake when their turn comes, and count anew."""
        if self.config.budget is None:
            return
        y = {p: self._classes(p) for p in self.counts} | self.asleep
        order = sorted(y, key=lambda p: (-leaves.promise(y[p], self.nodes[p].before, self.rows, self.nodes[p].up_error), p))
        for i, p in enumerate(order):
            if i < self.config.budget and p in self.asleep:
                self.earlier[p], self.counts[p] = self.asleep.pop(p), {}
            elif i >= self.config.budget and p in self.counts:
                del self.counts[p]
                self.earlier.pop(p, None)
                self.asleep[p] = y[p]

    def _classes(self, p: str) -> np.ndarray:
        """Rows of each class that a growing leaf has seen, those before it slept included."""
        now = self.counts[p].get(self.attributes[0], {})
        return sum(now.values(), np.zeros(self.classes, np.int64)) + self.earlier.get(p, 0)

    def _decide(self, p: str) -> list[str]:
        """Renews a leaf's class and splits it if its counts allow it; the children."""
        node, c = self.nodes[p], self.config
        y = sum(self.counts[p][self.attributes[0]].values())
        whole = self._classes(p)
        node.n, node.cls = int(whole.sum()), int(whole.argmax())
        live = [a for a in self.attributes if a not in self.off[p]]
        if (y > 0).sum() < 2 or not live or (c.max_depth is not None and node.depth >= c.max_depth):
            return []
        found: list[tuple[float, str, float | None]] = []
        for a in live:
            t = self.counts[p][a]
            if a in self.edges:
                bins = sorted(t)
                lower = np.array([self.edges[a][b - 1] if b else float("-inf") for b in bins])
                found += [(i, a, v) for i, _, v in hoeffding._best([(lower, np.stack([t[b] for b in bins]).astype(float))], c.gini)[0]]
            elif len(t) > 1:
                n = np.stack(list(t.values())).astype(float)
                found.append((float((n.sum(1) * hoeffding._impurity(n, c.gini)).sum() / n.sum()), a, None))
        two = sorted(found, key=lambda f: f[:2])[:2]
        what, _, _ = hoeffding._verdict([(i, 0, 0.0) for i, *_ in two], float(hoeffding._impurity(y.astype(float), c.gini)), len(self.attributes), int(y.sum()), self.classes, c)
        if what != "split":
            return []
        _, node.attr, node.threshold = two[0]
        if node.threshold is None:
            node.values = tuple(sorted(v for v in self.counts[p][node.attr] if v is not None))
        kids = [f"{p}<{i}>" for i in range(len(node.values))] if node.values is not None else [p + "L", p + "R"]
        error = 1 - y.max() / y.sum()
        for i, k in enumerate(kids):
            t = self.counts[p][node.attr]
            share = t[node.values[i]] if node.values is not None else sum((n for b, n in t.items() if (b and self.edges[node.attr][b - 1] >= node.threshold) == (k[-1] == "R")), np.zeros(self.classes))
            self.nodes[k] = hoeffding.Node(k, cls=node.cls, up=int(y.argmax()), before=float(np.sum(share)), up_error=float(error))
            self.counts[k] = {}
            self.off[k] = self.off[p] | {node.attr} if node.values is not None else self.off[p]
        del self.counts[p]
        self.earlier.pop(p, None)
        return kids

    def status(self) -> dict[str, int]:
        return {"rows": self.rows, "nodes": len(self.nodes), "depth": max(n.depth for n in self.nodes.values()), "growing": len(self.counts)} | ({} if self.config.budget is None else {"asleep": len(self.asleep)})


class StreamingClusters(_Following):
    """A CF tree that each micro-batch's partial entries are inserted into."""

    def __init__(self, vector: str, threshold: float, branching: int = 10, kind: str = "d0", most: int = 2000, path: str | None = None, spark: SparkSession | None = None):
        self.vector, self.threshold, self.branching, self.kind, self.most = vector, threshold, branching, kind, most
        self.tree: birch.CFTree | None = None
        self._open(path, spark)

    STATE = ("tree",)

    def _count(self, batch: DataFrame) -> None:
        for e in birch.partial_entries(batch, self.vector, self.threshold, self.branching, self.kind, self.most).collect():  # at most `most` a partition
            self.tree = self.tree or birch.CFTree(len(e["ls"]), self.threshold, self.branching, self.kind)
            self.tree.insert(e["n"], np.array(e["ls"]), e["ss"])

    def status(self) -> dict[str, float]:
        """The last batch, and the tree's points, entries, depth and threshold."""
        leaves = self.tree.leaves() if self.tree else []
        return {"batch": self.batch, "points": sum(n for _, n, *_ in leaves), "entries": len(leaves), "depth": max((len(x[4]) for x in leaves), default=0), "threshold": self.threshold}

    def nodes(self, spark: SparkSession) -> DataFrame:
        """path, kind, cf, cluster of the tree as it stands: for ``upkeep``, ``cftree.descend`` and the writers."""
        if self.tree is None:
            return spark.createDataFrame([], "path array<int>, kind string, cf struct<n:double,ls:array<double>,ss:double>, cluster long")
        return upkeep.with_inner(birch.entry_table(spark.range(1), self.tree))
