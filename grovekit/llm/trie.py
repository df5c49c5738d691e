"""Conversation prefix trie by partition refinement.

Conversations with equal turns so far are a class, which is a node of the trie. All start in one class. A round splits
the classes that are still active by their next turns; a class of one retires, and its tail is emitted as an unary
chain. A round covers 8 turns, the next ones twice as many each, so a long shared beginning takes few rounds. Classes
are counted where they lie before they are shuffled, and no conversation is ever joined to its class: what it needs it
gets by its own id.

Folding back: a conversation owns the nodes of which it is the smallest member, which are those of its path from some
depth on. So a subtree's leaves are the leaves owned by the members of its top, and its saved tokens are those that
its members own, less what the top's smallest member owns above the top: sums over members, as the counts were.

A conversation is held as one row with 16 bytes of digest and a length a turn; equal digests are taken for equal turns,
and sums of mixed digests (128 bits) for equal beginnings. Turns with equal numbers are in the order of their
digests. Rows without conv_id are left out; ``c - c % 100`` rounds down. Null role or text is empty; ('a', 'b') and
('', 'ab') differ. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

#: Turns of the first round.
TURNS = 8
#: Ids that go into one piece of a list of members.
PIECE = 4096
NOBODY = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: int, most: int = 6) -> int:
    """How many turns a rebuilt conversation takes from the first one of its hundred."""
    return zlib.crc32(str(conv_id).encode()) % most


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest, chars): conversations with their hundred's beginning."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    c = F.col("conv_id").cast("long")
    rows = conversations.where(c.isNotNull()).select(c.alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.char_length(text).alias("chars")).alias("t"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    each = each.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    bases = each.where(F.pmod("conv_id", F.lit(100)) == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, 5).alias("first"))
    both = each.withColumn("h", h).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(100))).join(bases, "base", "left")
    none = F.array().cast("array<struct<digest:string,chars:int>>")
    start, rest = F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    turns = F.concat(start, rest)
    return both.select("conv_id", F.size(turns).alias("len"), F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("digests"), F.transform(turns, lambda t: t["chars"]).alias("chars"))


_LEVEL = "depth int, a long, b long, up_a long, up_b long, conv_id long, chars int, leaves long, saved long"
_NAMES = [f.split()[0] for f in _LEVEL.split(", ")]
_KINDS = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int64()]
#: Rows that a task makes at once, unless one conversation has more.
_ROWS = 1 << 16


def _levels(first: int | None, last: int, upto: bool = False):
    """A row for each conversation and depth in [first, last], or to ``upto`` if rows have that; first None: the last depth alone."""

    def made(batch: pa.RecordBatch, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        data, offs = common.text_arrays(col["digests"])
        d, start = np.frombuffer(data.tobytes(), U64).reshape(-1, 2), offs // 16
        at = (np.arange(len(d)) - np.repeat(start[:-1], np.diff(start)) + 1).astype(U64) * U64(0x9E3779B97F4A7C15)
        sums = np.zeros((2, len(d) + 1), U64)  # differences are right, since both wrap around
        for j in (0, 1):
            np.cumsum(mix(mix(d[:, j]) + at), out=sums[j, 1:])
        n = np.maximum(hi - lo + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        depth = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        base = start[row]
        key = lambda j, k: (sums[j, base + k] - sums[j, base]).view(np.int64)
        up = np.maximum(depth - 1, 0)
        length = np.concatenate([np.asarray(col["chars"].flatten()), [0]]) if len(d) else np.zeros(1, np.int32)
        chars = np.where(depth > 0, length[np.minimum(base + up, len(d))], 0)
        own = [np.asarray(col[c])[row] if c in col else np.zeros(len(row), np.int64) for c in ("leaves", "saved")]
        out = [depth, key(0, depth), key(1, depth), key(0, up), key(1, up), np.asarray(col["conv_id"])[row], chars, *own]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, _KINDS, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(1)).astype(np.int64)
            hi = np.minimum(np.asarray(batch.column(batch.schema.get_field_index("upto"))).astype(np.int64) if upto else size, last)
            lo = np.full(len(hi), first) if first is not None else hi
            total = np.cumsum(np.maximum(hi - lo + 1, 0))
            a = 0
            while a < len(hi):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _ROWS, "right")))
                yield made(batch.slice(a, b - a), lo[a:b], hi[a:b])
                a = b

    return run


_KEY = ["depth", "a", "b"]


def _refined(convs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of two conversations or more (and the root), and where each retired conversation's tail begins.

    The first: depth, a, b, up_a, up_b, conv_id (smallest member), n, chars; the second: conv_id, depth, up_a, up_b.
    """
    active, lo, step, classes, single = convs, 0, TURNS, None, None
    while True:
        hi = lo + step
        long = active.select("conv_id", "len", "digests", "chars").mapInArrow(_levels(lo, hi), _LEVEL)
        found = scratch.table(long.groupBy(*_KEY).agg(F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("chars").alias("chars")), "classes")
        some = found.where("n > 1 OR depth = 0")
        alone = found.where("n = 1 AND depth > 0").groupBy("conv_id").agg(F.min(F.struct("depth", "up_a", "up_b")).alias("s")).select("conv_id", "s.*")
        classes, single = (some, alone) if classes is None else (classes.unionByName(some), single.unionByName(alone))
        rest = active.where(F.col("len") > hi).join(common.by_shuffle(alone.select("conv_id")), "conv_id", "left_anti")
        active = scratch.table(rest, "active")
        if active.isEmpty():
            return classes, single
        lo, step = hi + 1, 2 * step


def _streamed_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of lists that come piece by piece, one list after the other; a task holds one piece."""
    key, h = None, None
    for batch in batches:
        out = []
        for *k, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if k != key:
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["depth", "a", "b", "ends_sha256"]).cast(_ENDS)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, h.hexdigest())], names=["depth", "a", "b", "ends_sha256"]).cast(_ENDS)


_ENDS = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    common.importable(spark)
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    with common.Scratch() as scratch:
        convs = scratch.table(rebuilt(conversations), "conversations")
        classes, single = (scratch.table(x, n) for x, n in zip(_refined(convs, scratch), ("shared", "tails"), strict=True))
        # children of shared classes: shared ones and tails
        below = classes.where("depth > 0").select("up_a", "up_b", "depth").unionByName(single.select("up_a", "up_b", "depth"))
        kids = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
        shared = classes.join(common.by_shuffle(kids), _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        shared = scratch.table(shared.withColumn("own_saved", (F.col("n") - 1) * F.col("chars")), "nodes")
        # what each conversation owns among shared classes, and where its path leaves them
        owned = shared.groupBy("conv_id").agg(F.sum("own_saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaf"))
        per = convs.join(common.by_shuffle(owned), "conv_id", "left").join(common.by_shuffle(single.select("conv_id", F.col("depth").alias("alone"))), "conv_id", "left")
        leaves = F.coalesce("leaf", F.lit(0).cast("long")) + F.col("alone").isNotNull().cast("long")
        per = per.select("conv_id", "len", "digests", "chars", (F.coalesce("alone", F.col("len") + 1) - 1).cast("int").alias("upto"), "alone", leaves.alias("leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved"))
        per = scratch.table(per, "owners")
        # folding back, only as deep as a conversation shares its path, and the members that end in shared classes
        up = per.select("conv_id", "len", "digests", "chars", "upto", "leaves", "saved").mapInArrow(_levels(0, 1 << 30, upto=True), _LEVEL)
        up = up.groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("all_saved"))
        path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)  # nodes of one conversation
        before = shared.select("conv_id", "depth", F.coalesce(F.sum("own_saved").over(path), F.lit(0).cast("long")).alias("before"))
        ends = per.where("alone IS NULL").select("conv_id", "len", "digests", "chars").mapInArrow(_levels(None, 1 << 30), _LEVEL)
        pieces = ends.groupBy(*_KEY, F.expr(f"conv_id div {PIECE}").alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hashes = pieces.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, "piece").mapInArrow(_streamed_hash, "depth int, a long, b long, ends_sha256 string")
        full = shared.join(common.by_shuffle(up), _KEY).join(common.by_shuffle(hashes), _KEY, "left").join(common.by_shuffle(before), ["conv_id", "depth"])
        full = scratch.table(full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY))).withColumn("saved_tokens", F.col("all_saved") - F.col("before")), "folded")
        # parents by key: children of a hot parent are split by the join
        parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
        cols = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        root = full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*cols)
        inner = full.where("depth > 0").join(common.by_shuffle(parents), ["depth", "up_a", "up_b"]).select(*cols)
        heads = single.join(common.by_shuffle(parents), ["depth", "up_a", "up_b"]).select("conv_id", "parent_conv_id")
        tail = per.where("alone IS NOT NULL").select("conv_id", "len", "alone").join(common.by_shuffle(heads), "conv_id")
        chain = tail.select("conv_id", "len", "alone", "parent_conv_id", F.explode(F.sequence("alone", "len")).alias("depth"))
        last, zero, one = F.col("depth") == F.col("len"), F.lit(0).cast("long"), F.lit(1).cast("long")
        tails = chain.select("conv_id", "depth", F.when(F.col("depth") == F.col("alone"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, sha(F.col("conv_id"))).otherwise(F.lit(NOBODY)).alias("ends_sha256"))
        out = root.unionByName(inner).unionByName(tails)
        return common.Table(out.withColumn("depth", F.col("depth").cast("long")), "trie").read()
