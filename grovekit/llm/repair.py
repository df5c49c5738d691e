"""Operator 4, token-id output: Re-Pair grammars per shard with expansion lengths for random access.

A shard's ids are compressed in rounds. A round counts all adjacent pairs by sorting them, gives those that occur ``LEAST``
times or more a nonterminal each and replaces them, of overlapping ones the more frequent; pairs never cross a document's
end. Replacing many pairs a round instead of one keeps the work at a few passes over the shard. Only pairs with a new
symbol, or left over from the round before, can have become frequent, so later rounds look at these alone. It ends when no
pair pays for its rule. Symbols are stored in as many bits as the largest one needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Table, importable, mix, pack, parts_for, size_bytes, two
from .tokens import token_slices, vocabulary_size

SHARD_IDS = 1 << 20
#: A rule takes two symbols and a length; a pair that is replaced so often is shorter with it.
LEAST = 4
MAGIC = b"RPG2"
HEAD = "<4sIIIIQQBB"


def pack_bits(x: np.ndarray, width: int) -> bytes:
    """Numbers below 2**width, ``width`` bits each, the highest first."""
    out = []
    for i in range(0, len(x), 1 << 17):  # 2**17 x width bits are whole bytes
        bits = np.unpackbits(x[i : i + (1 << 17)].astype(">u8" if width > 32 else ">u4").view(np.uint8).reshape(-1, 8 if width > 32 else 4), axis=1)
        out.append(np.packbits(bits[:, -width:]).tobytes())
    return b"".join(out)


def unpack_bits(data: np.ndarray, width: int, a: int, b: int) -> np.ndarray:
    """Numbers a to b - 1 of packed bytes."""
    if a >= b:
        return np.zeros(0, np.int64)
    first = a * width // 8
    bits = np.unpackbits(data[first : (b * width + 7) // 8])[a * width - 8 * first :][: (b - a) * width].reshape(-1, width)
    wide = 64 if width > 32 else 32
    out = np.zeros((b - a, wide), np.uint8)
    out[:, wide - width :] = bits
    return np.packbits(out, axis=1).view(f">u{wide // 8}")[:, 0].astype(np.int64)


def _frequent(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which codes occur ``least`` times or more, sorted, how often, and for each place the number of its code there, or -1."""
    n = len(code)
    low = int(n).bit_length()
    if n and int(code.max()).bit_length() + low < 63:  # code and place in one number: one plain sort
        both = np.sort(code << low | np.arange(n))
        code, order = both >> low, both & ((1 << low) - 1)
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(first, n))
    often = count >= least
    number = np.full(n, -1, np.int64)
    number[order] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), count)
    return code[first[often]], count[often], number


def _winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of pairs that overlap the one of higher rank, of equal ones every second: copies of a passage are cut alike wherever they stand."""
    n = len(at)
    if not n:
        return np.zeros(0, bool)
    touch = np.diff(at) == 1
    before, after = np.full(n, -1), np.full(n, -1)
    before[1:], after[:-1] = np.where(touch, rank[:-1], -1), np.where(touch, rank[1:], -1)
    begin = np.maximum.accumulate(np.where(before == rank, 0, np.arange(n)))
    return (rank >= before) & (rank >= after) & ((np.arange(n) - begin) % 2 == 0)


def compress(ids: np.ndarray, offs: np.ndarray, base: int, least: int = LEAST) -> bytes:
    """One shard: documents are ids[offs[i]:offs[i+1]], all ids are below ``base``."""
    seq = ids.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[offs[1:][offs[1:] > offs[:-1]] - 1] = True
    empty = np.diff(offs) == 0
    rules: list[np.ndarray] = []
    top, look = base, ~last[:-1]
    while True:
        at = np.flatnonzero(look)
        codes, count, number = _frequent(seq[at].astype(np.int64) * top + seq[at + 1], least)
        at, number = at[number >= 0], number[number >= 0]
        take = _winners(at, ((count << 20) + (mix(codes) >> U64(44)).astype(np.int64))[number])
        good = np.bincount(number[take], minlength=len(codes)) >= least
        take &= good[number]
        if not take.any():
            break
        name = top + np.cumsum(good) - 1
        waiting = np.zeros(len(seq), bool)
        waiting[at] = True
        fresh = np.zeros(len(seq), bool)
        at, new = at[take], name[number[take]]
        seq[at], fresh[at] = new, True
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        seq, last, fresh, waiting = seq[keep], last[keep], fresh[keep], waiting[keep]
        look = (fresh[:-1] | fresh[1:] | waiting[:-1]) & ~last[:-1]
        rules.append(np.stack([codes[good] // top, codes[good] % top], 1))
        top += int(good.sum())
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    ends = np.zeros(len(offs), np.int64)
    ends[1:][~empty] = np.flatnonzero(last) + 1
    ends = np.maximum.accumulate(ends)
    length = np.ones(top, np.int64)
    done = base
    for r in rules:
        length[done : done + len(r)] = length[r[:, 0]] + length[r[:, 1]]
        done += len(r)
    width, wide = max(1, int(top - 1).bit_length()), int(length.max()).bit_length()
    head = struct.pack(HEAD, MAGIC, base, len(rule), len(rules), len(offs) - 1, len(seq), int(offs[-1]), width, wide)
    return head + pack(np.array([len(r) for r in rules], np.uint32)) + pack(ends.astype(np.uint64)) + pack_bits(rule.reshape(-1), width) + pack_bits(length[base:], wide) + pack_bits(seq, width)


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of all runs [a, b), one run after the other."""
    size = b - a
    ends = np.cumsum(size)
    return np.repeat(a - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Shard:
    """Reads one compressed shard; ``ids(i, a, b)`` expands only the symbols that it needs."""

    def __init__(self, data: bytes):
        magic, self.base, n_rules, n_rounds, n_docs, self.n_seq, self.n_ids, self.width, wide = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        self.rounds = np.frombuffer(data, np.uint32, n_rounds, at).astype(np.int64)
        at += 4 * n_rounds
        self.ends = np.frombuffer(data, np.uint64, n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        raw = np.frombuffer(data, np.uint8)
        self.rules = unpack_bits(raw[at:], self.width, 0, 2 * n_rules).reshape(-1, 2)
        at += (2 * n_rules * self.width + 7) // 8
        self.length = unpack_bits(raw[at:], wide, 0, n_rules)
        self.body = raw[at + (n_rules * wide + 7) // 8 :]

    def lengths(self, seq: np.ndarray) -> np.ndarray:
        out = np.ones(len(seq), np.int64)
        big = seq >= self.base
        out[big] = self.length[seq[big] - self.base]
        return out

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """Ids of symbols: the rules of the last round are undone first."""
        top = self.base + int(self.rounds.sum())
        for n in self.rounds[::-1].tolist():
            top -= n
            big = seq >= top
            if big.any():
                to = np.cumsum(1 + big) - 1
                pair = self.rules[seq[big] - self.base]
                seq = np.repeat(seq, 1 + big)
                seq[to[big] - 1], seq[to[big]] = pair[:, 0], pair[:, 1]
        return seq.astype(np.uint32)

    def ids(self, doc: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids [a, b) of one document by its symbols' expansion lengths."""
        seq = unpack_bits(self.body, self.width, int(self.ends[doc]), int(self.ends[doc + 1]))
        upto = np.cumsum(self.lengths(seq))
        total = int(upto[-1]) if len(upto) else 0
        b = total if b is None else min(b, total)
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(upto, a, "right"), np.searchsorted(upto, b, "left") + 1
        before = int(upto[i - 1]) if i else 0
        return self._expand(seq[i:j])[a - before : b - before]

    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols one after the other, and where each begins: each round's rules are put together from those before."""
        at = np.concatenate([np.arange(self.base + 1), self.base + np.cumsum(self.length)])
        out = np.zeros(int(at[-1]), np.uint32)
        out[: self.base] = np.arange(self.base)
        done = 0
        for n in self.rounds.tolist():
            parts = self.rules[done : done + n].reshape(-1)
            done += n
            out[at[self.base + done - n] : at[self.base + done]] = out[_runs(at[parts], at[parts + 1])]
        return out, at

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Every id, and the offsets of the documents."""
        seq = unpack_bits(self.body, self.width, 0, self.n_seq)
        ids, at = self._spelled()
        return ids[_runs(at[seq], at[seq + 1])], np.concatenate([[0], np.cumsum(self.lengths(seq))])[self.ends]


def write_tokens(docs: DataFrame, path: str, base: int | None = None, end_id: int = 0, keep_space: bool = True, label: str = "token-shards") -> Table:
    """Writes the shards of all documents in ascending doc_id order: (part, shard, doc_ids, n_ids, data).

    Null text counts as empty (its document is just ``end_id``); rows with a null doc_id come first; repeated rows
    are kept. ``base`` is the number of ids, by default the vocabulary's. Spark's writer commits each task's file once, so lost executors only repeat tasks.
    """
    importable(docs.sparkSession)
    spark = docs.sparkSession
    base = base or vocabulary_size(path)
    n = parts_for(spark, size_bytes(docs), 16 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, n_ids, names = TaskContext.get().partitionId(), 0, [], 0, []

        def row() -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held])
            lens = np.concatenate([np.diff(o) for _, o in held])
            data = compress(ids, np.concatenate([[0], np.cumsum(lens)]), base)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([sum(names, [])], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "shard", "doc_ids", "n_ids", "data"])

        for rows, ids, offs in token_slices(batches, path, keep_space, end_id):
            held.append((ids, offs))
            names.append(rows.column(0).to_pylist())
            n_ids += len(ids)
            if n_ids >= SHARD_IDS:
                yield row()
                shard, held, n_ids, names = shard + 1, [], 0, []
        if held:
            yield row()

    ordered = two(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return Table(ordered.mapInArrow(run, "part int, shard int, doc_ids array<long>, n_ids long, data binary"), label)


def read_tokens(shards: DataFrame) -> DataFrame:
    """Decodes shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, in stored order."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.select("part", "shard", within.alias("within")).join(before, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("shard").alias("s"), (F.col("within") + F.col("before")).alias("first"))
    rows = shards.join(placed, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select("doc_ids", "data", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offs = Shard(batch.column(1)[i].as_py()).all()
                raw = memoryview(pack(ids.astype("<u4")))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(offs[:-1] + batch.column(2)[i].as_py()), pa.array(np.diff(offs)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, path: str, base: int | None = None) -> DataFrame:
    """Writes all documents' ids as Re-Pair shards and reads the files back; an empty table gives no rows."""
    stored = write_tokens(docs, path, base)
    return read_tokens(stored.read())
