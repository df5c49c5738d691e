"""What the operators of this subpackage share: scratch tables, Arrow slices, word and shingle hashes.

Operators take any DataFrame with the columns ``doc_id`` and ``text`` and select just these two, so extra
columns never clash. Vectorised work happens on slices of about one megabyte of text, so a task's memory is bounded
by the longest single text rather than by its partition.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64
_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers that this driver starts import the package when it is not installed."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir. Only a local master, as in tests, gets a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(scratch_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        scratch_dir.own = base
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Intermediates that are still there.
OPEN: list[Table] = []


class Table:
    """A written intermediate: lineage ends here and any executor can read it.

    It stays while results that read it may be used: until ``drop``, ``release`` or the driver's end.
    """

    def __init__(self, df: DataFrame, label: str, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(self.path)
        self.schema = df.schema
        OPEN.append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        if self in OPEN:
            OPEN.remove(self)
            _delete(self.spark, self.path)


class Scratch:
    """The intermediates of one operator call: all go when the block ends, so the result must be a Table of its own by then."""

    def __init__(self) -> None:
        self.tables: list[Table] = []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, label: str, by: str | None = None) -> DataFrame:
        self.tables.append(Table(df, label, by))
        return self.tables[-1].read()

    def __exit__(self, *_: object) -> None:
        for t in self.tables:
            t.drop()
        if self.tables:
            free(self.tables[0].spark)


def free(spark: SparkSession) -> None:
    """Plans that nothing refers to any more give their shuffle files back when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(first: int = 0) -> None:
    """Drops the intermediates from number ``first`` of OPEN on; results that read them must have been written."""
    for t in OPEN[first:]:
        t.drop()


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        release()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: later reads survive lost executors and skip the work before."""
    scratch_dir(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of ``df`` has them; Spark ignores case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def by_shuffle(df: DataFrame) -> DataFrame:
    """For the side of a join that grows with the input: texts are joined to it the same way at every size."""
    return df.hint("merge")


def size_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (file sizes for scans), 0 where it has none; only used to choose numbers of partitions."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 56 else 0


def parts_for(spark: SparkSession, nbytes: int, each: int = 8 << 20) -> int:
    """Partitions of about ``each`` bytes, at least the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // each), 1)


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    bufs = col.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


#: What this worker keeps from task to task, by name: a task of another operator drops it, so that a worker that serves many never holds the sum.
KEPT: dict[tuple, object] = {}


def forget(but: tuple | None = None) -> None:
    """Drops all that is kept under other names, and gives Arrow's free memory back."""
    for name in [x for x in KEPT if x != but]:
        del KEPT[name]
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, kept: tuple | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of about ``most`` bytes of text each; a longer single text is a slice of its own. ``kept``: the one name in KEPT that the task uses."""
    forget(kept)
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_arrays(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b
    pa.default_memory_pool().release_unused()


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def edges_of(on: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes; runs end at row boundaries."""
    n = len(on)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = ~on[:-1]
    last[:-1] = ~on[1:]
    cuts = offs[1:-1]
    first[cuts[cuts < n]] = True
    last[cuts[cuts > 0] - 1] = True
    return np.flatnonzero(on & first), np.flatnonzero(on & last) + 1


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    return edges_of(~SPACE[data], offs)


_P = 0x9E3779B97F4A7C15
_M, _Q = (1 << 31) - 1, 1_284_865_837
_M64, _S31 = U64(_M), U64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A 64-bit value for each byte (splitmix64 of its number), and a 31-bit one.
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))
_BYTE31 = mix(np.arange(257, 513, dtype=U64) * U64(_P)) % _M64
#: Powers of both bases and of their inverses.
_POW: list[np.ndarray] = [np.ones(1, U64) for _ in range(4)]


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same rest modulo 2**31 - 1."""
    return (x & _M64) + (x >> _S31)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        n = max(n, SLICE_BYTES + 4096)
        for i, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            a = np.full(n, p, U64)
            a[0] = 1
            _POW[i] = np.cumprod(a)
        for i, p in enumerate((_Q, pow(_Q, -1, _M)), 2):
            a, k, top = np.ones(n, U64), 1, p
            while k < n:  # a[:k] is done, top is p**k
                a[k : 2 * k] = a[: min(k, n - k)] * U64(top) % _M64
                k, top = 2 * k, top * top % _M
            _POW[i] = a
    return _POW


Sums = tuple[np.ndarray, np.ndarray]


def prefix_hash(data: np.ndarray, quick: bool = False) -> Sums:
    """Prefix sums of value(data[j]) * base**j, modulo 2**64 and (not yet reduced) modulo 2**31 - 1.

    Sums modulo 2**64 alone are equal for some regular strings whatever the base; the second modulus tells those apart.
    ``quick``: only the first, for ``quick_hash``.
    """
    n = len(data)
    power = _powers(n + 1)
    out = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * power[0][:n], out=out[0][1:])
    if quick:
        return out[0], out[0]
    np.cumsum(_fold(_BYTE31[data] * power[2][:n]), out=out[1][1:])
    return out


def quick_hash(s: Sums, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit values of spans by the first sums alone: good to choose by, not to tell strings apart."""
    return mix((s[0][b] - s[0][a]) * _powers(len(s[0]))[1][a] + (b - a).astype(U64))


def span_hash(s: Sums, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [a, b) of the bytes that ``prefix_hash`` summed."""
    power = _powers(len(s[0]))
    x = (s[0][b] - s[0][a]) * power[1][a] + (b - a).astype(U64)
    y = (s[1][b] - s[1][a]) % _M64 * power[3][a] % _M64
    return mix(x ^ mix(y + U64(1)))


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it is in."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    a, b = words_of(data, offs)
    return span_hash(prefix_hash(data), a, b), np.searchsorted(offs, a, "right") - 1


def shingles_of(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles of one row's word hashes; fewer words: one for all of them."""
    n = len(h)
    if n == 0:
        return np.zeros(0, U64)
    m = min(n, k)
    out = np.full(n - m + 1, m, U64)
    for i in range(m):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[i : n - m + 1 + i])
    return np.unique(out)


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``shingles_of`` for many rows at once, row i having the words at[i] to at[i + 1]: all sets one after the other, and the bounds between them.

    Not ``ordered``: a set's hashes come in the order of the text, which spares sorting all of them.
    """
    n = np.diff(at)
    m = np.minimum(n, k)
    each = np.where(n > 0, n - m + 1, 0)
    row = np.repeat(np.arange(len(n)), each)
    first = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    size = m[row]
    out = size.astype(U64)
    if len(h) >= k:  # windows over all words; those that lie in one row are taken
        window = np.full(len(h) - k + 1, k, U64)
        for i in range(k):
            window = mix(window * U64(0xD6E8FEB86659FD93) + h[i : len(window) + i])
        whole = size == k
        out[whole] = window[first[whole]]
    for i in range(min(k - 1, int(m.max(initial=0)))):
        on = np.flatnonzero((size > i) & (size < k))
        out[on] = mix(out[on] * U64(0xD6E8FEB86659FD93) + h[first[on] + i])
    if not ordered:
        new = ~_repeats(out, row)
        return out[new], row_bounds(row[new], len(n))
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], row_bounds(row[new], len(n))


def _repeats(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which values occur in their row before; only values that occur twice at all are sorted by rows."""
    out, order = np.zeros(len(x), bool), np.argsort(x)
    same = x[order[1:]] == x[order[:-1]]
    twice = np.zeros(len(x), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    at = at[np.lexsort((at, row[at], x[at]))]
    out[at[1:]] = (x[at[1:]] == x[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
    return out


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1), "left")


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
