"""Exact top-k search by inner product: a Voronoi join of queries with all rows.

Adding one component sqrt(M - |s|**2) to every row s (M: the largest squared length) and 0 to every query q makes
|q - s|**2 = |q|**2 + M - 2 q.s, so the nearest rows are those of highest inner product, and bounds of distances apply:

* Pivots are rows drawn by their hashes; every row belongs to the cell of its nearest pivot and knows its distance to it.
* A cell's summary has its least and largest such distances and the k + 1 least ones. A query q finds at least k other
  rows within theta, the (k+1)-th least of |q, pivot| + |pivot, row| over all summaries (one of them may be its own row).
* So a row s of cell j can only matter to q if |q, p_j| - theta <= |s, p_j| <= |q, p_j| + theta, and not at all if the
  plane between p_j and q's own pivot is farther than theta. Queries are grouped by neighbouring cells; a group's
  range for a cell is the union of its queries' ranges, and a row goes to just the groups whose range holds it.
* A group's rows are dealt over blocks, each of which meets all the group's queries, a slice of rows at a time. Scores
  are exact; each block's best k of a query are ranked once more.

Bounds are widened by a millionth to outweigh rounding. Scores are sums of whole numbers, exact in doubles below 2**52;
beyond, they are computed as integers, and held and ranked at a long's ends. Ties go to the smaller vec_id. Rows with a null id
take no part. Repeated ids are separate rows, so that a query may find its id again, but never its own row. A query
finds fewer than k where there are fewer other rows. An empty table gives an empty result. See ``vectors`` for vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectors

#: Pivots, and the most bytes of them that go to every task.
PIVOTS, PIVOT_BYTES = 256, 4 << 20
#: Queries of a group, and rows of a block.
GROUP, BLOCK = 2048, 1 << 18
#: Ranges of groups that go to every task at once; more take several rounds.
RANGES = 1 << 20
_WIDE = 1e-6
_LONG = (1 << 63) - 1


class _Space:
    """Distances in the space with the added component. ``pivots``: a row each with that component."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.p, self.top = pivots, top
        self.p2 = (pivots * pivots).sum(1)

    def far(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Distances of rows x, whose added component is ``extra``, to all pivots."""
        x2 = (x * x).sum(1) + extra * extra
        d = x2[:, None] + self.p2 - 2 * (x @ self.p[:, :-1].T + extra[:, None] * self.p[:, -1])
        return np.sqrt(np.maximum(d, 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.far(x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0)))

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self.far(x, np.zeros(len(x)))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance: squares are off by some 1e-13 of the largest square, so small distances by its root."""
        return _WIDE * max(1.0, np.sqrt(self.top))


def _placed(kept: DataFrame, space: _Space, dim: int) -> DataFrame:
    """Adds each row's cell and its distance to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in vectors.blocks(batches, dim):
            d = space.rows(x)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])], names=["row", "vec_id", "vec", "cell", "far"])

    return kept.select("row", "vec_id", "vec").mapInArrow(run, "row long, vec_id long, vec binary, cell int, far double")


def _bounded(queries: DataFrame, space: _Space, dim: int, near: list[np.ndarray], k: int) -> DataFrame:
    """Adds theta to each query."""
    cells = np.concatenate([np.full(len(n), j) for j, n in enumerate(near)]).astype(int)
    added = np.concatenate(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in vectors.blocks(batches, dim):
            theta = np.full(len(x), np.inf)
            for a in range(0, len(x) if len(added) > k else 0, 256):
                theta[a : a + 256] = np.partition(space.queries(x[a : a + 256])[:, cells] + added, k, 1)[:, k]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(theta * (1 + _WIDE) + space.slack)], names=["row", "vec_id", "vec", "grp", "theta"])

    return queries.select("row", "vec_id", "vec", "grp").mapInArrow(run, "row long, vec_id long, vec binary, grp int, theta double")


def _ranges(queries: DataFrame, space: _Space, dim: int, least: np.ndarray, most: np.ndarray) -> DataFrame:
    """grp, cell, lo, hi: which rows of a cell may matter to a group. Each slice of queries reports a row a group and cell."""
    between = np.sqrt(np.maximum(space.p2[:, None] + space.p2 - 2 * space.p @ space.p.T, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in vectors.blocks(batches, dim):
            d, theta = space.queries(x), np.asarray(rows.column(4))[:, None]
            own = d.argmin(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - (d[np.arange(len(x)), own] ** 2)[:, None]) / (2 * between[own]) - 1e-12 * space.top / between[own]
            lo, hi = d - theta - space.slack, d + theta + space.slack
            out = (np.nan_to_num(plane, nan=0.0, neginf=0.0) > theta + space.slack) | (lo > most) | (hi < least)
            lo[out], hi[out] = np.inf, -np.inf
            grp = np.asarray(rows.column(3))
            order = np.argsort(grp, kind="stable")
            starts = np.flatnonzero(np.diff(grp[order], prepend=-1))
            lo, hi = np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)
            g, cell = np.nonzero(lo <= hi)
            yield pa.RecordBatch.from_arrays([pa.array(grp[order][starts][g], pa.int32()), pa.array(cell, pa.int32()), pa.array(lo[g, cell]), pa.array(hi[g, cell])], names=["grp", "cell", "lo", "hi"])

    one = queries.select("row", "vec_id", "vec", "grp", "theta").mapInArrow(run, "grp int, cell int, lo double, hi double")
    return one.groupBy("grp", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _exact(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    if small:
        return q @ x.T
    ints = [[int(v) for v in row] for row in x]
    return np.array([[max(-_LONG - 1, min(_LONG, sum(int(a) * b for a, b in zip(row, other, strict=True) if a))) for other in ints] for row in q], object)


def _solver(dim: int, k: int, small: bool):
    """Blocks come one after the other, each one's queries before its rows: per query the best k of a block."""

    def best(scores: np.ndarray, ids: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of each query among a slice's scores (None: its own row) and those held: query, id, score, in order."""
        q, c = np.nonzero(scores >= _kth(scores, k)[:, None]) if small else np.nonzero(np.ones(scores.shape, bool))
        value = scores[q, c]
        real = value > -np.inf
        q, i, v = np.concatenate([held[0], q[real]]), np.concatenate([held[1], ids[c[real]]]), np.concatenate([held[2], value[real]])
        order = np.lexsort((i, -v, q)) if small else np.array(sorted(range(len(q)), key=lambda n: (q[n], -v[n], i[n])), int)
        q, i, v = q[order], i[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        return q[rank < k], i[rank < k], v[rank < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, own, vecs, held, put = None, [], [], [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if held is not None and len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(put[1][held[0]]), pa.array(put[0][held[0]]), pa.array(held[1].astype(np.int64)), pa.array([int(v) for v in held[2]], pa.int64())], names=["row", "query_id", "vec_id", "score"])

        for batch, x in vectors.blocks(batches, dim):
            block, kind, row, ident = (np.asarray(batch.column(j)) for j in range(4))
            cuts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[a] != at:
                    yield from done()
                    at, ids, own, vecs, held = block[a], [], [], [], None
                if kind[a] == 0:
                    ids.append(ident[a:b]), own.append(row[a:b]), vecs.append(x[a:b])
                    continue
                if held is None:
                    put = np.concatenate(ids), np.concatenate(own), np.concatenate(vecs)
                    held = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0) if small else np.zeros(0, object)
                    by = np.argsort(put[1])
                    sought = put[1][by]
                for s in range(a, b, 512):
                    e = min(b, s + 512)
                    scores = _exact(put[2], x[s:e], small)
                    n = np.minimum(np.searchsorted(sought, row[s:e]), len(sought) - 1)
                    mine = np.flatnonzero(sought[n] == row[s:e])
                    scores[by[n[mine]], mine] = -np.inf
                    held = best(scores, ident[s:e], held)
        yield from done()

    return run


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    n = scores.shape[1]
    return np.partition(scores, n - k, 1)[:, n - k] if n > k else np.full(len(scores), -np.inf)


def _chain(space: _Space) -> np.ndarray:
    """Pivots in an order in which each is followed by its nearest one not yet named."""
    n = len(space.p)
    d = np.sqrt(np.maximum(space.p2[:, None] + space.p2 - 2 * space.p @ space.p.T, 0))
    order, left = [0], np.ones(n, bool)
    left[0] = False
    while left.any():
        nxt = int(np.where(left, d[order[-1]], np.inf).argmin())
        order.append(nxt)
        left[nxt] = False
    return np.array(order)


def top_k(spark: SparkSession, df: DataFrame, k: int = 10, every: int = 100, vector: str = "embedding", scale: float = 1024.0, pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose id is divisible by ``every``."""
    common.importable(spark)
    with common.Scratch() as scratch:
        found = vectors.floored(df.select(F.col("vec_id").cast("long").alias("vec_id"), vector).where("vec_id IS NOT NULL"), ["vec_id"], vector, scale)
        kept = scratch.table(found.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so numbers stay
        dim = max(1, vectors.longest(kept))
        drawn = kept.orderBy(F.xxhash64("vec_id", "vec"), "row").limit(max(1, min(pivots, PIVOT_BYTES // (8 * dim)))).select("vec").collect()  # bounded: at most 4 MB
        if not drawn:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        p = np.unique(vectors.matrix(pa.array([bytes(r[0]) for r in drawn], pa.binary()), dim), axis=0)
        top = _largest(kept, dim)
        extra = np.sqrt(np.maximum(top - (p * p).sum(1), 0))
        space, small = _Space(np.column_stack([p, extra]), top), top < 2.0**52
        placed = scratch.table(_placed(kept, space, dim), "cells")

        is_query = F.pmod("vec_id", F.lit(every)) == 0
        seen = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.min("far").alias("least"), F.max("far").alias("most")).collect()}  # a row a pivot
        first = F.row_number().over(Window.partitionBy("cell").orderBy("far", "row"))
        near = [[] for _ in p]
        for r in placed.select("cell", "far", "row").withColumn("_r", first).where(F.col("_r") <= k + 1).collect():  # k + 1 a pivot
            near[r["cell"]].append(r["far"])
        get = lambda name, none: np.array([seen[j][name] if j in seen else none for j in range(len(p))])
        counts, asked = get("n", 0), get("q", 0)
        if not asked.sum():
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        # groups: cells along the chain until one has its queries; a cell with more takes several groups
        base, width, grp, filled = np.zeros(len(p), int), np.ones(len(p), int), 0, 0
        for j in _chain(space):
            if filled and filled + asked[j] > group:
                grp, filled = grp + 1, 0
            base[j], width[j] = grp, max(1, -(-int(asked[j]) // group))
            grp, filled = grp + width[j] - 1, filled + asked[j] if width[j] == 1 else group
        dealt = _by_cell(base) + F.pmod(F.xxhash64("row"), _by_cell(width)).cast("int")
        queries = placed.where(is_query).withColumn("grp", dealt)
        queries = scratch.table(_bounded(queries, space, dim, [np.array(n) for n in near], k), "queries")
        ranges = scratch.table(_ranges(queries, space, dim, get("least", np.inf), get("most", -np.inf)), "ranges")
        # blocks: as many as a group's rows need at most, and no fewer than there are tasks in all
        groups, tasks, each = grp + 1, int(spark.conf.get("spark.sql.shuffle.partitions")), F.sum(_by_cell(counts)).alias("n")
        need = {r["grp"]: max(-(-r["n"] // block), -(-tasks // groups), 1) for r in ranges.groupBy("grp").agg(each).collect()}  # a row a group of 2048 queries
        starts = np.concatenate([[0], np.cumsum([need.get(g, 1) for g in range(groups)])])
        parts = []
        per = max(1, RANGES // len(p))
        for g in range(0, groups, per):  # one round up to some thousand groups
            mine = ranges.where(F.col("grp").between(g, g + per - 1))
            at = spark.createDataFrame([(i, int(starts[i]), int(starts[i + 1] - starts[i])) for i in range(g, min(groups, g + per))], "grp int, start int, blocks int")
            mine = mine.join(F.broadcast(at), "grp")
            to = F.broadcast(mine)  # at most RANGES rows
            sent = placed.join(to, "cell").where(F.col("far").between(F.col("lo"), F.col("hi")))
            data = sent.select((F.col("start") + F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).alias("block"), F.lit(1).alias("kind"), "row", "vec_id", "vec")
            asks = queries.join(F.broadcast(at), "grp").select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "row", "vec_id", "vec")
            n = int(starts[min(groups, g + per)] - starts[g])
            both = data.unionByName(asks).repartition(min(n, 20_000), "block").sortWithinPartitions("block", "kind")
            parts.append(both.mapInArrow(_solver(dim, k, small), "row long, query_id long, vec_id long, score long"))
        found = parts[0]
        for other in parts[1:]:
            found = found.unionByName(other)
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
        return common.Table(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk").read()


def _by_cell(values: np.ndarray):
    """A cell's number from a list with one for each pivot."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)


def _largest(kept: DataFrame, dim: int) -> float:
    """The largest squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for _, x in vectors.blocks(batches, dim):
            most = max(most, float((x * x).sum(1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    return float(kept.select("vec").mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 0.0)
