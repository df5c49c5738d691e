"""Operator 9, exact substring dedup by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. Sorting all suffixes of a corpus is not
needed for that: each window of ``length`` bytes has an anchor, the leftmost least hash of the ``shallow``-byte strings in it,
so equal windows have equal anchors at equal places. The shallow sort deals anchors by that string; anchors that
occur once end there. What is left are segments: an anchor with the bytes of all the windows that own it. Equal segments are
counted, never compared. Among the different segments of one anchor, the suffixes at the anchor and the reversed
prefixes before it go through multikey quicksort on 8-byte keys to a shallow depth; groups still tied are ordered by
blind tries. The longest common prefixes to the right and left of two anchors tell which of their windows are equal.
Sorting needs an anchor's segments in one task, and a passage in a third of all documents has as many different segments
at its ends. So anchors with more than ``SORTED_TOGETHER`` of them are settled by counting their windows' hashes instead,
which never brings a group together; both ways give the same windows.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, Table, by_shuffle, importable, mix, parts_for, prefix_hash, quick_hash, size_bytes, slices, span_hash, unused
from .sharing import key32, shared_keys

#: Different segments of one anchor that a task sorts together; more go by window hashes.
SORTED_TOGETHER = 48
#: Lists of up to so many anchors (8 bytes each) are sent to all executors; longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SHALLOW_KEYS = 2
#: Neighbouring windows that are looked at together first.
BLOCK = 8


# Sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie_sort(strings: list[bytes], depth: int = 0) -> tuple[list[int], list[int]]:
    """Order of strings that share ``depth`` bytes, and the common prefix of each with the one before it (0 for the first).

    A blind trie keeps only branching depths and the bytes there. A new string first goes down without looking at
    skipped bytes, is compared once with the leaf it meets, and then is put in where it really branches.
    """
    leaf = lambda i: [-1, i]  # noqa: E731  inner nodes: [depth, bytes, children]; -1 is the end of a string
    at = lambda s, d: s[d] if d < len(s) else -1
    equal: dict[int, list[int]] = {}
    root = leaf(0)
    for i, s in enumerate(strings[1:], 1):
        node, path = root, []
        while node[0] >= 0:
            path.append(node)
            k = bisect_left(node[1], at(s, node[0]))
            node = node[2][k] if k < len(node[1]) and node[1][k] == at(s, node[0]) else node[2][0]
        other = strings[node[1]]
        lcp = depth + common_prefix(s[depth:], other[depth:])
        if lcp == len(s) == len(other):
            equal.setdefault(node[1], []).append(i)
            continue
        up = None
        for p in path:
            if p[0] > lcp:
                break
            up = p
        if up is not None and up[0] == lcp:
            k = bisect_left(up[1], at(s, lcp))
            up[1].insert(k, at(s, lcp))
            up[2].insert(k, leaf(i))
            continue
        below = root if up is None else up[2][bisect_left(up[1], at(s, up[0]))]
        two = sorted([(at(s, lcp), 0, leaf(i)), (at(other, lcp), 1, below)])
        new = [lcp, [two[0][0], two[1][0]], [two[0][2], two[1][2]]]
        if up is None:
            root = new
        else:
            up[2][bisect_left(up[1], at(s, up[0]))] = new
    order, lcps, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if node[0] < 0:
            order.append(node[1])
            lcps.append(before)
            for j in equal.get(node[1], ()):
                order.append(j)
                lcps.append(len(strings[j]))
        else:
            for k in range(len(node[2]) - 1, -1, -1):
                stack.append((node[2][k], before if k == 0 else node[0]))
    return order, lcps


def multikey_quicksort(rows: list[int], keys: list[tuple[int, ...]], at: int = 0) -> list[list[int]]:
    """Groups of rows with equal keys, in order: a three-way split by the key at place ``at``; only the middle part moves on to the next place."""
    out: list[list[int]] = []
    stack = [(rows, at)]
    while stack:
        rows, at = stack.pop()
        if len(rows) < 2 or at == len(keys[rows[0]]):
            out.append(rows)
            continue
        pivot = keys[rows[len(rows) // 2]][at]
        less, same, more = [r for r in rows if keys[r][at] < pivot], [r for r in rows if keys[r][at] == pivot], [r for r in rows if keys[r][at] > pivot]
        stack += [(part, step) for part, step in ((more, at), (same, at + 1), (less, at)) if part]
    return out


def deep_shallow_sort(strings: list[bytes], keys: int = SHALLOW_KEYS) -> tuple[list[int], list[int]]:
    """Order and common prefixes with the predecessor: multikey quicksort on 8-byte keys to the shallow depth, then blind tries."""
    n, depth = len(strings), 8 * keys
    if n < 3:
        return blind_trie_sort(strings)
    words = struct.Struct(f">{keys}Q").unpack
    order, lcps = [], []
    for group in multikey_quicksort(list(range(n)), [words(s[:depth].ljust(depth, b"\0")) for s in strings]):
        deep = all(len(strings[i]) >= depth for i in group)
        o, c = ([0], [0]) if len(group) == 1 else blind_trie_sort([strings[i] for i in group], depth if deep else 0)
        c[0] = common_prefix(strings[order[-1]], strings[group[o[0]]]) if order else 0
        order += [group[i] for i in o]
        lcps += c
    return order, lcps


def shared_windows(segments: list[tuple[bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For different segments of one anchor, the ranges of windows that another one has too.

    A segment is (bytes, low, high): its windows start from ``high`` down to ``low`` bytes before the anchor, and its bytes
    begin ``high`` bytes before it. A range (p, q) has the windows that start p to q bytes before the anchor.
    """
    right = [s[h:] for s, _, h in segments]
    left = [s[:h][::-1] for s, _, h in segments]
    ro, rl = deep_shallow_sort(right)
    lo, ll = deep_shallow_sort(left)
    place = {i: k for k, i in enumerate(lo)}
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    n = len(segments)
    for x in range(n):
        i, r = ro[x], 1 << 30
        for y in range(x + 1, n):
            r = min(r, rl[y])
            j = ro[y]
            if r < length - segments[i][2]:
                break
            a, b = sorted((place[i], place[j]))
            both = min(ll[a + 1 : b + 1])
            p, q = max(length - r, segments[i][1], segments[j][1]), min(both, segments[i][2], segments[j][2])
            if p <= q:
                out[i].append((p, q))
                out[j].append((p, q))
    return out


# Anchors


def anchors(data: np.ndarray, offs: np.ndarray, length: int, shallow: int, quick: bool = False) -> tuple[np.ndarray, ...]:
    """row, anchor's place, its key, first and last window start, of all anchors of the rows; and the prefix hash (``quick``: good for keys only)."""
    n, w = len(data), length - shallow + 1
    s = prefix_hash(data, quick)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint32), none, none, s
    at = np.arange(n - shallow + 1)
    h = quick_hash(s, at, at + shallow)
    width = U64(max(20, int(n).bit_length()))
    packed = (h >> width << width) | at.astype(U64)
    m = len(packed) - w + 1
    pad = -len(packed) % w
    p = np.concatenate([packed, np.full(pad, ~U64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(p, 1).reshape(-1)
    behind = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:m]
    start = np.flatnonzero(np.arange(m) + length <= offs[row + 1])
    x = (least[start] & U64((1 << int(width)) - 1)).astype(np.int64)
    if not len(start):
        return none, none, none.astype(np.uint32), none, none, s
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (row[start][1:] != row[start][:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return row[start[first]], x[first], key32(mix(h[x[first]])), start[first], start[last], s  # least hashes are small numbers: mixed, they spread as keys


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 400, shallow: int = 100) -> Table:
    """doc_id, h (hash of the text), and a and b (starts and ends in bytes of spans that repeated windows cover, in any order)

    ``docs`` has doc_id, text (string or binary, null: empty), h and perhaps at, the place of a part of a text in the whole.
    The same row twice counts as two places. What is written on the way goes before this returns.
    """
    with Scratch() as scratch:
        return Table(_repeated_spans(spark, docs, length, shallow, scratch), "repeated-spans")


def _repeated_spans(spark: SparkSession, docs: DataFrame, length: int, shallow: int, scratch: Scratch) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, data, offs in slices(batches):
            yield anchors(data, offs, length, shallow, quick=True)[2]

    known = shared_keys(docs, keys, 2 / (length - shallow))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            row, x, key, first, last, s = anchors(data, offs, length, shallow)
            use = known.shared(key) if len(key) else np.zeros(0, bool)
            row, x, first, last = row[use], x[use], first[use], last[use]
            fp = span_hash(s, x, x + shallow)
            low, high = x - last, x - first
            seg = mix(span_hash(s, first, last + length) ^ mix((low * 4096 + high).astype(U64)))
            raw, seen, body = data.tobytes(), set(), []
            for g, a, b in zip(seg.tolist(), first.tolist(), (last + length).tolist(), strict=True):
                body.append(None if g in seen else raw[a:b])
                seen.add(g)
            doc, h, base = rows.column(0), rows.column(rows.schema.get_field_index("h")), rows.schema.get_field_index("at")
            take, before = pa.array(row), rows.column(base).to_numpy()[row] if base >= 0 else 0
            yield pa.RecordBatch.from_arrays([doc.take(take), h.take(take), pa.array(x - offs[row] + before), pa.array(fp.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(body, pa.binary())], names=["doc_id", "h", "x", "fp", "seg", "low", "high", "body"])

    places = scratch.table(docs.mapInArrow(segments, "doc_id long, h long, x long, fp long, seg long, low int, high int, body binary"), "segments")
    known.destroy()  # written: nothing will be computed from it again
    counted_ = places.groupBy("fp", "seg").agg(F.count("*").alias("k"), F.max("low").alias("low"), F.max("high").alias("high"))
    kinds = scratch.table(counted_, "segment-counts")
    by = scratch.table(kinds.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1"), "contested-anchors")
    several, many = by.where(F.col("c") <= SORTED_TOGETHER).select(F.col("fp").alias("f")), by.where(F.col("c") > SORTED_TOGETHER).select(F.col("fp").alias("f"))

    def bodies(of: DataFrame) -> DataFrame:
        """One row for each different segment of these anchors; only these segments' bytes are shuffled."""
        side = F.broadcast(of) if of.count() <= BROADCAST_ROWS else of
        met = places.where("body IS NOT NULL").join(side, F.col("fp") == F.col("f"), "left_semi")
        return met.groupBy("fp", "seg").agg(F.max("body").alias("body"), F.max("low").alias("low"), F.max("high").alias("high"))

    n = parts_for(spark, 2 * size_bytes(kinds))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []

        def settle() -> None:
            for (fp, seg, *_), ranges in zip(held, shared_windows([x[2:] for x in held], length), strict=True):
                if ranges:
                    out.append((fp, seg, [p for p, _ in ranges], [q for _, q in ranges]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            b = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32()))], names=["fp", "seg", "p", "q"])
            out.clear()
            return b

        for batch in batches:
            for fp, seg, body, low, high in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[0][0] != fp:
                    settle()
                    held.clear()
                held.append((fp, seg, body, low, high))
            if len(out) > 5000:
                yield flush()
        if held:
            settle()
        if out:
            yield flush()

    sorted_ = bodies(several).repartition(n, "fp").sortWithinPartitions("fp", "seg").mapInArrow(together, "fp long, seg long, p array<int>, q array<int>")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each segment and block of BLOCK neighbouring windows: hashes of their common bytes, of all their bytes, and of each."""
        names = ["fp", "seg", "b", "core", "whole", "o", "w"]
        for rows, data, offs in slices(batches, "body"):
            s, high = prefix_hash(data), rows.column(rows.schema.get_field_index("high")).to_numpy().astype(np.int64)
            each = np.diff(offs) - length + 1
            i = np.repeat(np.arange(len(each)), each)
            at = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
            a, o = offs[i] + at, high[i] - at
            code = mix(span_hash(s, a, a + length) ^ mix(o.astype(U64)))
            block = o // BLOCK
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (i[1:] != i[:-1])])) if len(i) else np.zeros(0, np.int64)
            x = offs[i[first]] + high[i[first]]  # the anchor's place
            b = block[first]
            core = mix(span_hash(s, x - b * BLOCK, x - b * BLOCK - BLOCK + 1 + length) ^ mix(b.astype(U64)))
            start, end = x - b * BLOCK - BLOCK + 1, x - b * BLOCK + length
            inside = (start >= offs[i[first]]) & (end <= offs[i[first] + 1])
            whole = mix(span_hash(s, np.maximum(start, 0), np.minimum(end, len(data))) ^ mix(b.astype(U64)))
            ends = pa.array(np.append(first, len(i)).astype(np.int32))
            take = pa.array(i[first])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(b), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64), mask=~inside), pa.ListArray.from_arrays(ends, pa.array(o.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(code.view(np.int64)))], names=names)

    hashed = scratch.table(bodies(many).select("fp", "seg", "body", "high").mapInArrow(blocks, "fp long, seg long, b long, core long, whole long, o array<int>, w array<long>"), "window-blocks")

    def twice(column: str) -> DataFrame:
        return hashed.where(F.col(column).isNotNull()).groupBy("fp", "b", column).agg(F.count("*").alias("c")).where("c > 1").select(F.col("fp").alias(f"f_{column}"), F.col("b").alias(f"b_{column}"), F.col(column).alias(f"h_{column}"))

    def met(df: DataFrame, column: str, how: str) -> DataFrame:
        return df.join(twice(column), (F.col("fp") == F.col(f"f_{column}")) & (F.col("b") == F.col(f"b_{column}")) & (F.col(column) == F.col(f"h_{column}")), how)

    # blocks that two segments have as a whole are settled; those whose common bytes are alone have no shared window
    whole = met(hashed, "whole", "left_semi").select("fp", "seg", (F.col("b") * BLOCK).cast("int").alias("p"), (F.col("b") * BLOCK + BLOCK - 1).cast("int").alias("q"))
    open_ = met(met(hashed, "core", "left_semi"), "whole", "left_anti")
    single = scratch.table(open_.select("fp", "seg", F.explode(F.arrays_zip("o", "w")).alias("e")).select("fp", "seg", "e.o", "e.w"), "open-windows")
    known_w = met(hashed, "whole", "left_semi").groupBy("fp", "b", "whole").agg(F.min("w").alias("w")).select("fp", F.explode("w").alias("w"))  # each different block once
    pairs_w = single.groupBy("fp", "w").agg(F.count("*").alias("c")).where("c > 1").select("fp", "w").unionByName(known_w).distinct().select(F.col("fp").alias("f"), F.col("w").alias("v"))
    shared_w = single.join(pairs_w, (F.col("fp") == F.col("f")) & (F.col("w") == F.col("v")), "left_semi").select("fp", "seg", F.col("o").alias("p"), F.col("o").alias("q"))
    counted = whole.unionByName(shared_w).groupBy("fp", "seg").agg(F.collect_list(F.struct("p", "q")).alias("r")).select("fp", "seg", F.col("r.p").alias("p"), F.col("r.q").alias("q"))
    copies = kinds.where("k > 1").select("fp", "seg", F.array("low").alias("p"), F.array("high").alias("q"))
    ranges = sorted_.unionByName(counted).unionByName(copies).select(F.col("fp").alias("f"), F.col("seg").alias("g"), "p", "q")
    hits = places.select("doc_id", "h", "x", "fp", "seg").join(ranges, (F.col("fp") == F.col("f")) & (F.col("seg") == F.col("g")))
    ends = F.zip_with("p", "q", lambda p, q: F.struct((F.col("x") - q).alias("a"), (F.col("x") - p + length).alias("b")))
    per = hits.select("doc_id", "h", ends.alias("e")).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("e")).alias("spans"))
    return per.select("doc_id", "h", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))


def _key(docs: DataFrame) -> tuple[Column, Column, Column]:
    text = F.col("text").cast("string")
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), text, F.xxhash64(text)


def _spans_of(spark: SparkSession, docs: DataFrame, length: int, shallow: int) -> DataFrame:
    key, text, h = _key(docs)
    return repeated_spans(spark, docs.select(key.alias("doc_id"), text.alias("text"), h.alias("h")), length, shallow).read()


def _unions(a: pa.Array, b: pa.Array) -> list[list[tuple[int, int]]]:
    """For each row, its spans joined where they meet, in order; null lists have none."""
    rows = np.repeat(np.arange(len(a)), pc.fill_null(pc.list_value_length(a), 0).to_numpy())
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(a))]
    if not len(rows):
        return out
    far = rows << 40  # rows lie apart
    low, high = a.flatten().to_numpy() + far, b.flatten().to_numpy() + far
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    row = low[first] >> 40
    start, stop = low[first] - (row << 40), high[np.append(first[1:], len(low)) - 1] - (row << 40)
    for r, x, y in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True):
        out[r].append((x, y))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return [*kept, raw[at:]]


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def _report_rows(rows: list[tuple]) -> pa.RecordBatch:
    """(doc_id, raw or None, sha256 of the whole text, its size, spans, bytes in passages or None)."""
    out = []
    for doc, raw, sha, size, spans, passage in rows:
        if spans:
            digest = hashlib.sha256()
            for part in _kept(raw, spans):
                digest.update(part)
            sha = digest.hexdigest()
        out.append((doc, size, sum(b - a for a, b in spans), len(spans), sha, [list(x) for x in spans]) + ((passage,) if passage is not None else ()))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.int64())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=names[: len(out[0])])


def substring_report(spark: SparkSession, docs: DataFrame, length: int = 400, shallow: int = 100, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges) of each row.

    With ``passage`` (fewer bytes than ``length``) also n_passage_bytes: how many bytes strings of that length cover which start elsewhere
    too. Those are found first; a repeated string of ``length`` bytes lies within a run of them, so only such runs are searched again.

    Null and empty texts have no bytes; repeated rows are repeats of each other and so lose their windows; a null doc_id
    stays null; an empty table gives no rows.
    """
    importable(spark)
    docs = docs.select("doc_id", "text")
    key, text, h = _key(docs)
    found = _spans_of(spark, docs, passage or length, min(shallow, passage // 6) if passage else shallow).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "a", "b")
    joined = docs.join(by_shuffle(found), (key == F.col("d")) & (h == F.col("g")), "left").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("d"), h.alias("g"), "a", "b")

    if passage is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, offs in slices(batches):
                raws = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield _report_rows([(d, raw, hashlib.sha256(raw).hexdigest(), len(raw), x, None) for d, raw, x in zip(rows.column(0).to_pylist(), raws, _unions(rows.column(2), rows.column(3)), strict=True)])

        return joined.select("doc_id", "text", "a", "b").mapInArrow(run, _REPORT)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts go on only where a run is long enough."""
        for rows, data, offs in slices(batches):
            out = []
            for i, (d, k, g, spans) in enumerate(zip(*(rows.column(j).to_pylist() for j in (0, 2, 3)), _unions(rows.column(4), rows.column(5)), strict=True)):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                runs = [list(s) for s in spans if s[1] - s[0] >= length]
                out.append((d, k, g, len(raw), hashlib.sha256(raw).hexdigest(), sum(b - a for a, b in spans), runs, raw if runs else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "d", "g", "n_bytes", "sha", "passage", "runs", "raw"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, "raw"):
            out = [(d, g, data[offs[i] + a : offs[i] + b].tobytes(), a) for i, (d, g, runs) in enumerate(zip(*(rows.column(j).to_pylist() for j in range(3)), strict=True)) for a, b in runs]
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            cols = [[o[i] for o in out] for i in (0, 2, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "text", "h", "at"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, "raw"):
            raws = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            cols = [rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "sha", "n_bytes", "passage")]
            yield _report_rows([(d, raw, sha, n, x, p) for raw, x, d, sha, n, p in zip(raws, _unions(rows.column(5), rows.column(6)), *cols, strict=True)])

    seen = Table(joined.mapInArrow(first, "doc_id long, d long, g long, n_bytes long, sha string, passage long, runs array<array<long>>, raw binary"), "passages").read()
    long_ = repeated_spans(spark, seen.where("raw IS NOT NULL").select("d", "g", "runs", "raw").mapInArrow(parts, "doc_id long, text binary, h long, at long"), length, shallow).read()
    both = seen.join(by_shuffle(long_.select(F.col("doc_id").alias("e"), F.col("h").alias("f"), "a", "b")), (F.col("d") == F.col("e")) & (F.col("g") == F.col("f")), "left")
    return both.select("doc_id", "sha", "n_bytes", "passage", "raw", "a", "b").mapInArrow(last, _REPORT + ", n_passage_bytes long")


def without_repeats(spark: SparkSession, docs: DataFrame, length: int = 400, shallow: int = 100) -> DataFrame:
    """All rows and columns of ``docs``, repeated bytes out of ``text``; bytes of a character cut in two go as well.

    n_chars, where there is one, is counted anew. Rows left without text stay, with empty text.
    """
    importable(spark)
    d, g, low, high = unused(docs, "d", "g", "a", "b")
    key, _, h = _key(docs)
    found = _spans_of(spark, docs, length, shallow).select(F.col("doc_id").alias(d), F.col("h").alias(g), F.col("a").alias(low), F.col("b").alias(high))
    joined = docs.join(by_shuffle(found), (key == F.col(d)) & (h == F.col(g)), "left").drop(d, g)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            text, size = [], []
            where, null = rows.schema.get_field_index("text"), rows.column(rows.schema.get_field_index("text")).is_null().to_pylist()
            for i, spans in enumerate(_unions(rows.column(rows.schema.get_field_index(low)), rows.column(rows.schema.get_field_index(high)))):
                kept = "".join(part.decode(errors="ignore") for part in _kept(data[offs[i] : offs[i + 1]].tobytes(), spans))
                text.append(None if null[i] else kept)
                size.append(len(kept))
            cols = [rows.column(rows.schema.get_field_index(c)) for c in names]
            cols[names.index("text")] = pa.array(text, rows.schema.field(where).type)
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array(size, cols[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.schema)
