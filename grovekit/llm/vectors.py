"""Vectors as whole numbers: what the operators on ``embeddings`` share.

A vector takes part if it is not null and all its components are finite numbers. Its components become
floor(scale * x), stored as little-endian doubles, which hold such numbers exactly. Vectors of different lengths
are padded with zeros on their right to the longest one's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of components that a task handles at once.
BLOCK_BYTES = 4 << 20


def floored(df: DataFrame, keep: list[str], vector: str, scale: float, limit: float | None = None) -> DataFrame:
    """The columns ``keep`` and ``vec`` (bytes) of the rows whose vector takes part. Components beyond ``limit`` on either side are held there."""
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(len(keep))
            at, offs = np.flatnonzero(np.asarray(pc.is_valid(col))), np.asarray(col.offsets, np.int64)
            x = np.asarray(col.values.cast(pa.float64()).fill_null(float("nan")))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            at = at[bad[offs[at + 1]] == bad[offs[at]]]
            with np.errstate(over="ignore"):
                v = np.floor(x * scale)  # powers of two: the product is exact
            if limit is not None:
                v = np.clip(v, -limit, limit)
            vec = pa.array([v[offs[i] : offs[i + 1]].tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(len(keep))), vec], names=[*keep, "vec"])

    x = F.col(vector).cast("array<double>")
    return df.select(*keep, x.alias("_vec")).mapInArrow(run, schema)


def longest(df: DataFrame) -> int:
    """Components of the longest vector; 0 without vectors."""
    return int(df.agg(F.max(F.octet_length("vec"))).first()[0] or 0) // 8


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of bytes, a row each, padded to ``dim``."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.float64) if offs[-1] > offs[0] else np.zeros(0)
    n = np.diff(offs) // 8
    if len(raw) == len(col) * dim:
        return raw.reshape(len(col), dim)
    out = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), n)
    out[row, np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)] = raw
    return out


def blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their vectors, about ``BLOCK_BYTES`` at once."""
    step = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, matrix(part.column(part.schema.get_field_index("vec")), dim)
