"""Vector code compression: product codebooks fitted and applied in whole numbers, so that results never depend on the order of sums.

Finding the nearest entry is screened by one float32 matrix product a part. Rounding moves such a product by at most
gamma * |v| * |c|, with gamma = (L + 2) u / (1 - (L + 2) u) for L components and u = 2**-24 (two roundings of the
factors, L of the sum, in any order); so each entry has an interval that holds its true squared distance. Where only
one entry's interval reaches down to the lowest upper end, it is the nearest; all others that do are computed anew in
int64, and the least distance with the lowest index wins.

Components are held at +-2**27 (less in parts of over 8), so that errors fit a long: with a scale of 4096 that is
|x| < 32768. Vectors are padded with zeros to a multiple of ``parts``. Repeated ids are separate rows; where they are
among the first, the order is that of their bytes. A null id is never among the first. With fewer rows than entries
there are as many entries as rows. An empty table gives an empty result. A sum of errors beyond a long is held there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vectors

_U = 2.0**-24
#: Labels up to this number go to every task; more are joined by a shuffle.
FEW_LABELS = 20_000


def nearest_entries(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry and its squared distance, and how many distances had to be computed anew. v, c: int64, a row each."""
    n = v.shape[1] + 2
    gamma = n * _U / (1 - n * _U)
    c2 = (c * c).sum(1).astype(float)
    size_v, size_c = np.sqrt((v.astype(float) ** 2).sum(1)), np.sqrt(c2)
    product = (v.astype(np.float32) @ c.astype(np.float32).T).astype(float)
    s = c2 - 2 * product  # but for |v|**2, which all entries of a row share
    r = 2.00001 * gamma * size_v[:, None] * size_c + (c2 + np.abs(s)) * 2.0**-50
    reach = s - r <= (s + r).min(1, keepdims=True)
    best = reach.argmax(1)
    unsure = np.flatnonzero(reach.sum(1) > 1)
    row, entry = np.nonzero(reach[unsure])
    if len(row):
        d = ((v[unsure[row]] - c[entry]) ** 2).sum(1)
        least = np.minimum.reduceat(d, np.flatnonzero(np.diff(row, prepend=-1)))
        hit = np.flatnonzero(d == least[row])
        first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        best[unsure] = entry[first]
    return best, ((v - c[best]) ** 2).sum(1), len(row)


def _assigner(books: np.ndarray):
    parts, _, width = books.shape

    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = x.astype(np.int64).reshape(len(x), parts, width)
        got = [nearest_entries(v[:, p], books[p]) for p in range(parts)]
        return np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)

    return assign


def _sums(vecs: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place, total, n of what is nearest to each entry: a small table from each task, then summed up."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, total, n = _assigner(books), np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in vectors.blocks(batches, parts * width):
            best, _ = assign(x)
            for p in range(parts):
                n[p] += np.bincount(best[:, p], minlength=entries)
                for j in range(width):
                    total[p, :, j] += np.bincount(best[:, p], x[:, p * width + j], entries).astype(np.int64)  # under 2**53: exact
        p, e, j = (i.ravel() for i in np.indices(books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (p, e, j, total.ravel(), np.repeat(n.ravel(), width))], names=["part", "entry", "place", "total", "n"])

    long = vecs.select("vec").mapInArrow(run, "part long, entry long, place long, total long, n long")
    return long.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def fit(vecs: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) of rows vec_id, vec: int64. The driver sees codebooks and sums only."""
    width = max(1, -(-dim // parts))
    first = vecs.where("vec_id IS NOT NULL").orderBy("vec_id", "vec").limit(entries).select("vec").collect()  # entries rows
    start = np.zeros((len(first), parts * width))
    for i, r in enumerate(first):
        x = np.frombuffer(r[0])
        start[i, : len(x)] = x
    books = start.astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        for r in _sums(vecs, books).collect():  # parts x entries x width
            if r["n"]:
                books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def _coded(vecs: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    parts, _, width = books.shape
    schema = T.StructType([vecs.schema["vec_id"], T.StructField("label", vecs.schema[label].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(books)
        for rows, x in vectors.blocks(batches, parts * width):
            best, d = assign(x)
            hexed = best.astype(np.uint8).tobytes().hex()
            code = [hexed[i : i + 2 * parts] for i in range(0, len(hexed), 2 * parts)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(code, pa.string()), pa.array(d.sum(1))], names=schema.names)

    return vecs.select("vec_id", label, "vec").mapInArrow(run, schema)


def compress(spark: SparkSession, df: DataFrame, vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector takes part (see ``vectors``, and above)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    common.importable(spark)
    with common.Scratch() as scratch:
        raw = vectors.floored(df, ["vec_id", label], vector, scale)
        vecs = scratch.table(raw, "vectors")
        dim = vectors.longest(vecs)
        width = max(1, -(-dim // parts))
        limit = min(1 << 27, math.isqrt((1 << 62) // (4 * parts * width)))
        held = vecs.mapInArrow(_held(limit), vecs.schema)
        books = fit(held, dim, parts, entries, rounds)
        flat = ",".join(str(x) for x in books.ravel().tolist())
        if books.shape[1]:
            out = _coded(held, books, label)
        else:  # no row takes part
            kinds = [vecs.schema["vec_id"], T.StructField("label", vecs.schema[label].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
            out = spark.createDataFrame([], T.StructType(kinds))
        coded = common.Table(out, "codes").read()
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error"))
    sums = common.Table(sums, "labels").read().withColumnRenamed("label", "_label")
    if sums.count() <= FEW_LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:  # by a shuffle, a label's rows over 16 tasks
        salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        dealt = coded.withColumn("_r", F.pmod(F.xxhash64("vec_id", "code"), F.lit(16)).cast("int"))
        out = dealt.join(common.by_shuffle(salted), F.col("label").eqNullSafe(F.col("_label")) & (F.col("_r") == F.col("_s")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(flat.encode()).hexdigest()).alias("codebooks_sha256"))


def _held(limit: int):
    """Holds components at +-limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("vec")
            col = batch.column(k)
            if len(col) and col.buffers()[2] is not None:
                offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
                raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.float64)
                if len(raw) and np.abs(raw).max() > limit:
                    kept = np.clip(raw, -limit, limit).view(np.uint8).tobytes()
                    batch = batch.set_column(k, "vec", pa.array([kept[a - offs[0] : b - offs[0]] for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary()))
            yield batch

    return run
