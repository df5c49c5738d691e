"""The events that build clustering-feature trees, as a table, and any step's tree rebuilt from it.

A task inserts its range of points in order and logs what each one does: ``absorb`` (entry), ``add`` (entry, node and position), ``split``
(node, its two halves and the positions that went left) and ``root`` (node above two halves). Replaying takes no distances: it moves numbers
about and adds features up, so a log can be cut at any step of any part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clustering
from .birch import CFTree, _Node

#: The most points of a part, about: one task inserts them and one replays them.
PART_ROWS = 1 << 18

LOG = "part int, step long, seq long, kind string, entry long, node long, position long, left long, right long, went array<long>, ls array<double>"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.float64())]
_COLS = [f.split()[0] for f in LOG.split(", ")]


class LoggedTree(CFTree):
    """A tree that says what each insertion does. Nodes have numbers; the first root is 0."""

    def __init__(self, dim: int, threshold: float = 1.0, branching: int = 10, kind: str = "d0"):
        super().__init__(dim, threshold, branching, kind)
        self.names: dict[_Node, int] = {self.root: 0}
        self.events: list[tuple] = []

    def _named(self, node: _Node) -> int:
        return self.names.setdefault(node, len(self.names))

    def _absorbs(self, entry: int, ls: np.ndarray) -> None:
        self.events.append(("absorb", entry, None, None, None, None, None, ls.tolist()))

    def _adds(self, entry: int, node: _Node, at: int, ls: np.ndarray) -> None:
        self.events.append(("add", entry, self._named(node), at, None, None, None, ls.tolist()))

    def _rises(self) -> None:
        self.events.append(("root", None, self._named(self.root), None, *(self._named(x) for x in self.root.kids), None, None))

    def _overflow(self, node: _Node) -> tuple[_Node, _Node] | None:
        halves = super()._overflow(node)
        if halves:
            kids = {id(k) if isinstance(k, _Node) else k: i for i, k in enumerate(node.kids)}
            went = [kids[id(k) if isinstance(k, _Node) else k] for k in halves[0].kids]
            self.events.append(("split", None, self._named(node), None, self._named(halves[0]), self._named(halves[1]), went, None))
        return halves


def logged(df: DataFrame, vector: str, order: list[str], parts: int, threshold: float = 1.0, branching: int = 10, kind: str = "d0") -> DataFrame:
    """The log (part, step, seq, ...) of a tree per range of the order; steps count a part's points from 0. Null vectors have no step.

    There are ``parts`` ranges, or more if these would have over ``PART_ROWS`` points each. A task holds its part's tree and the events of one batch.
    """
    parts = max(parts, -(-df.count() // PART_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, step, seq, part = None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            rows, col = [], batch.column(0).drop_null()
            if not len(col):
                continue
            for x in col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1):
                tree = tree or LoggedTree(len(x), threshold, branching, kind)
                tree.insert(1.0, x, float(x @ x))
                for e in tree.events:
                    rows.append((part, step, seq, *e))
                    seq += 1
                tree.events.clear()
                step += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_COLS)

    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, LOG)


def replay(log: DataFrame, step: int | None = None) -> DataFrame:
    """part, path, kind, n, ls, ss of each part's tree after ``step`` (None: the last): entries and nodes, the root with the empty path.

    Entries are added up by an aggregate; a task has the other events of a part, which are few where points are absorbed.
    """

    def rebuilt(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        kids: dict[int, list[int]] = {0: []}  # of leaves: entries, below 0 as -1 - entry
        above: dict[int, int] = {}
        root, pdf = 0, pdf.sort_values("seq")
        sums = {int(e): (float(n), np.asarray(ls, float), float(ss)) for e, n, ls, ss in zip(entries["entry"], entries["n"], entries["ls"], entries["ss"], strict=True)}
        for e in pdf.itertuples():
            if e.kind == "add":
                kids[int(e.node)].insert(int(e.position), -1 - int(e.entry))
            elif e.kind == "split":
                node, left, right = int(e.node), int(e.left), int(e.right)
                mine, went = kids.pop(node), set(map(int, e.went))
                for half, inside in ((left, True), (right, False)):
                    kids[half] = [k for i, k in enumerate(mine) if (i in went) == inside]
                    above.update({k: half for k in kids[half] if k >= 0})
                if node in above:
                    up = above.pop(node)
                    at = kids[up].index(node)
                    kids[up][at : at + 1] = [left, right]
                    above[left] = above[right] = up
                else:
                    root = left  # until the event of the new root
            else:
                root = int(e.node)
                kids[root] = [int(e.left), int(e.right)]
                above[int(e.left)] = above[int(e.right)] = root
        rows, part = [], int(pdf["part"].iloc[0])

        def walk(k: int, path: list[int]) -> tuple[float, np.ndarray, float]:
            if k < 0:
                total = sums[-1 - k]
            else:
                each = [walk(x, [*path, i]) for i, x in enumerate(kids[k])]
                total = tuple(sum(c) for c in zip(*each, strict=True))
            rows.append((part, path, "entry" if k < 0 else "node", total[0], np.asarray(total[1]).tolist(), total[2]))
            return total

        walk(root, [])
        return pd.DataFrame(rows, columns=["part", "path", "kind", "n", "ls", "ss"])

    mine = log if step is None else log.where(F.col("step") <= step)
    sums = clustering.features(mine.where(F.col("kind").isin("add", "absorb")), ["part", "entry"], "ls")
    return mine.where("kind <> 'absorb'").drop("ls").groupBy("part").cogroup(sums.groupBy("part")).applyInPandas(rebuilt, "part int, path array<int>, kind string, n double, ls array<double>, ss double")
