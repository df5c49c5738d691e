"""Quoted records of delimited files, read in blocks: a file takes as many tasks as it has blocks.

Whether a line end ends its record depends on all quotes before it in the file. A block can't know those, but it can
say, for either case, in which one it leaves the next block and where the record that it leaves open began. The first
pass reports that, a row a block; blocks are put one after the other per file; the second pass then knows each block's
case and offset and makes its records. Records that lie across blocks are put together from their pieces, at most two
a block. Cells open quotes at their beginning only (blanks may come before), and "" inside quotes is a quote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

#: Blocks whose cases go to every task (some 100 bytes each); more are joined by a shuffle.
MANY_BLOCKS = 200_000

#: Bytes of small blocks that a task takes, about.
TASK_BYTES = 128 << 20

_LINE = "value binary, file string, block long"
_BLANK = b" \t\r\x0b\x0c"


def leaves_open(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Is a quote open at the end of this line, if one was (``inside``) or wasn't at its beginning?"""
    i, n = 0, len(line)
    while True:
        if not inside:
            while i < n and line[i] in _BLANK and line[i : i + 1] != sep:
                i += 1
            inside = line[i : i + 1] == b'"'
            i += inside
        if inside:
            while True:
                i = line.find(b'"', i)
                if i < 0:
                    return True
                if line[i + 1 : i + 2] != b'"':
                    break
                i += 2
            inside = False
        i = line.find(sep, i)
        if i < 0:
            return False
        i += 1


def _session(spark: SparkSession, block_bytes: int | None) -> SparkSession:
    """The session, or one with the same settings but this size of blocks."""
    if block_bytes is None:
        return spark
    other = spark.newSession()
    for k, v in dict(spark.conf.getAll).items():
        if spark.conf.isModifiable(k):
            other.conf.set(k, v)
    other.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    other.conf.set("spark.sql.files.openCostInBytes", "0")
    return other


def _lines(spark: SparkSession, paths: str | list[str], recursive: bool, suffixes: tuple[str, ...]) -> DataFrame:
    r = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive)
    if suffixes:
        r = r.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    return r.text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


class _Run:
    """Lines of one block that came together: their bytes, where each begins, and which have quotes."""

    def __init__(self, col: pa.Array, file: str, block: int):
        self.file, self.block, self.n = file, block, len(col)
        offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
        self.at, self.data = offs - offs[0], raw.tobytes()
        quotes = np.concatenate([[0], np.cumsum(raw == 34)])
        self.quoted = np.flatnonzero(np.diff(quotes[self.at]))
        self.starts = self.at + np.arange(self.n + 1)  # with the line ends

    def line(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(1), np.asarray(batch.column(2))
        new = np.diff(block, prepend=block[0] - 1) != 0
        if batch.num_rows > 1:
            new[1:] |= np.asarray(pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)))
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _Run(batch.column(0).slice(a, b - a), file[a].as_py(), int(block[a]))


_CASES = "file string, block long, bytes long, open_if_out boolean, start_if_out long, open_if_in boolean, start_if_in long"


def _cases(sep: bytes):
    """What a block does in either case. start: where the record left open begins in the block, -1 if before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, case = None, 0, []

        def row() -> pa.RecordBatch:
            values = (*key, size, *(x for c in case for x in c))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _CASES.split(", ")])

        for r in _runs(batches):
            if (r.file, r.block) != key:
                if key:
                    yield row()
                key, size, case = (r.file, r.block), 0, [(False, -1), (True, -1)]
            for i in r.quoted.tolist():
                line = r.line(i)
                after = {now: leaves_open(line, now, sep) for now in {c[0] for c in case}}
                case = [(after[now], (size + int(r.starts[i]) if not now else start)) if after[now] else (False, -1) for now, start in case]
            size += int(r.starts[-1])
        if key:
            yield row()

    return run


def _entered(blocks: pd.DataFrame) -> pd.DataFrame:
    """A file's blocks in order: each one's offset, whether a quote is open at its beginning and end, and where the record at its beginning began."""
    off, inside, start, out = 0, False, -1, []
    for b in blocks.sort_values("block").itertuples():
        goes, at = (b.open_if_in, b.start_if_in) if inside else (b.open_if_out, b.start_if_out)
        out.append((b.file, b.block, off, inside, start, bool(goes)))
        start = (off + at if at >= 0 else start) if goes else -1
        off, inside = off + b.bytes, bool(goes)
    return pd.DataFrame(out, columns=["file", "block", "base", "inside", "began", "leaves"])


_RECORD = "file string, off long, len long, block long, value binary"


def _records(sep: bytes, pieces: bool):
    """Records that lie within a block, or only the pieces of those that don't (off: the record's)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, base, began, held, whole = None, False, 0, -1, [], False

        def rest() -> list[tuple]:
            """The open record at a block's end."""
            return [(key[0], began, 0, key[1], b"\n".join(held))] if held and pieces else []

        for part in batches:
            cases = [np.asarray(part.column(i)) for i in (3, 4, 5)]
            row, out = 0, []
            for r in _runs(iter([part])):
                if (r.file, r.block) != key:
                    out += rest()
                    key, held = (r.file, r.block), []
                    base, inside, began = int(cases[0][row]), bool(cases[1][row]), int(cases[2][row])
                    whole = not inside  # did the open record begin in this block?
                row += r.n
                done = 0
                for i in [*r.quoted.tolist(), r.n]:
                    if not inside:  # lines up to the next one with quotes are records
                        if not pieces:
                            out += [(r.file, base + int(r.starts[k]), int(r.at[k + 1] - r.at[k]), r.block, r.line(k)) for k in range(done, i)]
                    else:
                        held += [r.line(k) for k in range(done, i)]
                    done = i + 1
                    if i == r.n:
                        break
                    goes = leaves_open(r.line(i), inside, sep)
                    if not inside:
                        began, whole, held = base + int(r.starts[i]), True, []
                    held.append(r.line(i))
                    if not goes:
                        value = b"\n".join(held)
                        if whole and not pieces:
                            out.append((r.file, began, len(value), r.block, value))
                        elif pieces and not whole:
                            out.append((r.file, began, 0, r.block, value))
                        held, whole = [], True
                    inside = goes
                base += int(r.starts[-1])
            if out:
                yield batch(out)
        if last := rest():
            yield batch(last)

    return run


def read_records(spark: SparkSession, paths: str | list[str], sep: str = ",", recursive: bool = False, suffixes: tuple[str, ...] = (), block_bytes: int | None = None) -> DataFrame:
    """file, off (byte offset, a record's identity), len (bytes without the last line end), value of each record, blank ones included.

    An unclosed quote takes the rest of its file. A record is held whole by a task. ``block_bytes``: blocks of this size
    instead of the session's ``spark.sql.files.maxPartitionBytes``.
    """
    own = _session(spark, block_bytes)
    lines, mark = _lines(own, paths, recursive, suffixes), sep.encode()
    blocks, each = lines.rdd.getNumPartitions(), block_bytes or TASK_BYTES
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-blocks * each // TASK_BYTES))
    if blocks > tasks:  # small blocks: a task takes many, one after the other
        lines = lines.coalesce(tasks)
    found = cut(lines.mapInArrow(_cases(mark), _CASES).groupBy("file").applyInPandas(_entered, "file string, block long, base long, inside boolean, began long, leaves boolean"))
    n = found.count()
    at = found.withColumnsRenamed({"file": "_file", "block": "_block"})

    def placed(rows: DataFrame, which: DataFrame) -> DataFrame:
        on = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
        if n <= MANY_BLOCKS:
            out = rows.join(F.broadcast(which), on)  # the scan's order stays
        else:
            out = rows.withColumn("_i", F.monotonically_increasing_id()).join(which.hint("merge"), on).repartition("file", "block").sortWithinPartitions("file", "block", "_i")
        return out.select("value", "file", "block", "base", "inside", "began")

    whole = placed(lines, at).mapInArrow(_records(mark, False), _RECORD).select("file", "off", "len", F.col("value").cast("string").alias("value"))
    touched = at.where("inside OR leaves")
    if not touched.isEmpty():  # only blocks that a record enters or leaves are parsed again
        parts = placed(lines, touched).mapInArrow(_records(mark, True), _RECORD)
        joined = parts.groupBy("file", "off").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"))
        value = F.array_join(F.transform("p", lambda x: x["value"].cast("string")), "\n")
        whole = whole.unionByName(joined.select("file", "off", value.alias("value")).withColumn("len", F.octet_length("value").cast("long")))
    return whole
