"""Operator 5, best-fit packing after Martello-Toth dominance reduction.

Only a histogram of piece lengths (at most ``capacity`` numbers, whatever the input) reaches the driver. The plan made from
it maps (length, rank among pieces of that length) to a sequence and an offset; executors apply it to all pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Table, importable, pack, two
from .tokens import token_slices


def reduce_dominated(count: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fixes sequences that dominate every other one with their largest piece, and takes them out of ``count``.

    A set dominates if each alternative's pieces fit into its pieces' places: a piece with which nothing fits, a
    pair that fills the sequence, and, where no two pieces fit beside the largest, that one with the largest that
    fits. Runs until nothing more can be fixed. Returns (((length, copies), ...), sequences) patterns.
    """
    fixed: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(sizes: tuple[int, ...], k: int) -> None:
        for s in sizes:
            count[s] -= k
        fixed.append((tuple((s, 1) for s in sizes), int(k)))

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            if not count[s]:
                continue
            rest = capacity - s
            if rest == 0:
                take((s,), count[s])
                changed = True
                continue
            k = count[s] // 2 if rest == s else min(count[s], count[rest])
            if k:
                take((s, rest), k)
                changed = True
            while count[s]:
                present = np.flatnonzero(count[: rest + 1])
                if s <= rest and count[s] == 1:
                    present = present[present != s]
                if not len(present):
                    take((s,), 1 if s <= rest else count[s])
                    changed = True
                    continue
                small = int(present[0])
                others = int(count[small]) - (small == s)
                second = small if others >= 2 else int(present[1]) if len(present) > 1 else capacity + 1
                if small + second <= rest:
                    break
                best = int(present[-1])
                take((s, best), 1 if best == s else min(count[s], count[best]))
                changed = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram; equal sequences stay together as one pattern."""
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(left: int, pattern: tuple[tuple[int, int], ...], k: int) -> None:
        if left not in room or not room[left]:
            if left not in room:
                insort(rooms, left)
            room[left] = []
        room[left].append((pattern, k))

    def fill(left: int, pattern: tuple[tuple[int, int], ...], k: int, s: int, n: int) -> int:
        """Puts up to n pieces of length s into k equal sequences; how many went in."""
        each = left // s
        full = min(k, n // each)
        if full:
            put(left - each * s, (*pattern, (s, each)), full)
        more = n - full * each
        part = 1 if full < k and 0 < more else 0
        if part:
            used = min(more, each)
            put(left - used * s, (*pattern, (s, used)), 1)
        else:
            used = 0
        if k - full - part:
            put(left, pattern, k - full - part)
        return full * each + used

    for s in range(capacity, 0, -1):
        n = int(count[s])
        while n:
            i = bisect_left(rooms, s)
            while i < len(rooms) and not room[rooms[i]]:
                del room[rooms[i]]
                del rooms[i]
            if i < len(rooms):
                left = rooms[i]
                pattern, k = room[left].pop()
                n -= fill(left, pattern, k, s, n)
            else:
                n -= fill(capacity, (), -(-n // (capacity // s)), s, n)
    return [p for r in rooms for p in room[r]]


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Arrays sorted by key = length << 44 | first rank: the sequence of that rank and the offset in it."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        count[s] = n
    patterns = reduce_dominated(count, capacity) + best_fit(count, capacity)
    given = np.zeros(capacity + 1, np.int64)
    key, seq, off, base = [], [], [], 0
    for pattern, k in patterns:
        at = 0
        for s, copies in pattern:
            for _ in range(copies):
                key.append((s << 44) | int(given[s]))
                seq.append(base)
                off.append(at)
                given[s] += k
                at += s
        base += k
    order = np.argsort(np.array(key, np.int64))
    return {"key": np.array(key, np.int64)[order], "seq": np.array(seq, np.int64)[order], "off": np.array(off, np.int64)[order], "sequences": np.array([base])}


def pieces(docs: DataFrame, path: str, capacity: int, keep_space: bool = False, with_ids: bool = False) -> Table:
    """doc_id, piece, start, length, ids_crc32 and the piece's number among those of its task and length."""
    importable(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "ord"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids, offs in token_slices(batches, path, keep_space):
            lens = np.diff(offs)
            n = -(-lens // capacity)
            doc = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, lens[doc] - start)
            raw = memoryview(pack(ids.astype("<u4")))
            a = offs[doc] + start
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
            by = np.argsort(length, kind="stable")
            sorted_len = length[by]
            first = np.searchsorted(sorted_len, sorted_len, "left")
            ord_ = np.empty(len(by), np.int64)
            ord_[by] = np.arange(len(by)) - first + seen[sorted_len]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(ord_)]
            if with_ids:
                cols.append(pa.array([ids[i:j] for i, j in zip(a, a + length, strict=True)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ord long" + ", ids array<long>" * with_ids
    return Table(two(docs).mapInArrow(run, schema), "pieces")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, capacity: int = 2048, keep_space: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Each document ends with id 0, so null and empty texts are pieces of one token; repeated rows are packed each;
    ties between pieces of a length go by writing task and order there; an empty table gives no rows.
    """
    stored = pieces(docs, path, capacity, keep_space, with_ids)
    rows = stored.read()
    sizes = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placed = plan(histogram, capacity)
    first = sizes.select(F.col("part").alias("p"), F.col("length").alias("l"), (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    ranked = rows.join(first, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("first") + F.col("ord")).drop("p", "l", "first", "part", "ord")
    shared = spark.sparkContext.broadcast(placed)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)) for n in (*names, "rank")}
            rank, length = col["rank"].to_numpy(), col["length"].to_numpy()
            at = np.searchsorted(p["key"], (length << 44) | rank, "right") - 1
            sequence = p["seq"][at] + rank - (p["key"][at] & ((1 << 44) - 1))
            yield pa.RecordBatch.from_arrays([*(col[n] for n in names), pa.array(sequence), pa.array(p["off"][at])], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
