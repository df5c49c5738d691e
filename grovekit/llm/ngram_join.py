"""Operator 1, n-gram Jaccard join by prefix lists with set-relation skipping.

Every text is its set of word shingles. Shingles are ordered by frequency class over all texts, then by hash; sets at
similarity t share one of the first n - ceil(t n) + 1. Of these only shingles that occur in two texts are listed.
Equal sets count once. ``sharing.link_counts`` finds all links, deriving sets' answers from their leader's; where only the
components are wanted, ``sharing.linked_sets`` skips pairs that are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, Table, by_shuffle, free, importable, pack, row_bounds, shingles_of, slices, two, unused, word_hashes
from .sharing import components, key40, link_counts, linked_sets, set_id, shared_keys


#: First keys of a set's order that its pairs are told apart by: the rest of its keys never makes a pair that these have made.
HEADS = 8


def _shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, data, offs in slices(batches):
        h, row = word_hashes(data, offs, lower=True)
        at = row_bounds(row, rows.num_rows)
        yield rows, [shingles_of(h[a:b], k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _together(shingles: Iterator[tuple[pa.RecordBatch, list[np.ndarray]]], least: int) -> Iterator[list[tuple[list[int | None], list[np.ndarray]]]]:
    """Slices' doc_ids and sets, as many slices as have ``least`` shingles."""
    held, n = [], 0
    for rows, sets in shingles:
        held.append((rows.column(0).to_pylist(), sets))
        n += sum(map(len, sets))
        if n >= least:
            yield held
            held, n = [], 0
    if held:
        yield held


def similar_texts(spark: SparkSession, docs: DataFrame, k: int = 3, percent: int = 90, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked with it, itself included), n_copies (texts with an equal set), n_links.

    n_links is the number of other texts that are similar enough, equal sets included; without ``links`` it is left out.

    Null texts and texts without words have empty sets, which link with nothing: their component is their own doc_id.
    Repeated rows share a component. Null doc_ids are never a component's id, unless it has no other.
    """
    importable(spark)
    with Scratch() as scratch:
        return Table(_similar_texts(spark, two(docs), k, percent, links, scratch), "similar-texts").read()


def _similar_texts(spark: SparkSession, docs: DataFrame, k: int, percent: int, links: bool, scratch: Scratch) -> DataFrame:

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in _shingles(batches, k):
            yield key40(np.concatenate(sets)) if sets else np.zeros(0, U64)

    known = shared_keys(docs, keys, 0.25, width=40, parts=True)
    free(spark)  # the keys' shuffle goes before sets are written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(_shingles(batches, k), known.together):
            every = key40(np.concatenate([s for _, sets in held for s in sets]))
            levels, shared, at = known.levels(every).astype(np.int64), known.shared(every), 0
            for names, sets in held:
                out: list[tuple] = []
                seen: set[bytes] = set()
                for doc, s in zip(names, sets, strict=True):
                    n = len(s)
                    v, twice, at = levels[at : at + n], shared[at : at + n], at + n
                    sig = set_id(s) if n else b""
                    out.append(("doc", doc, sig, n, None, None, None, None))
                    if not n or sig in seen:
                        continue
                    seen.add(sig)
                    order = np.lexsort((s, np.where(twice, 1 + v, 0)))[: n - (percent * n + 99) // 100 + 1]
                    listed = np.flatnonzero(twice[order])
                    if len(listed):
                        own = s[order[listed]].view(np.int64).tolist()
                        out.append(("set", None, sig, n, None, None, pack(s), own[:HEADS]))
                        out += [("key", None, sig, n, x, p, None, None) for x, p in zip(own, listed.tolist(), strict=True)]
                cols = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "doc_id", "sig", "n", "key", "pos", "blob", "heads"])

    rows = scratch.table(docs.mapInArrow(run, "kind string, doc_id long, sig binary, n int, key long, pos int, blob binary, heads array<long>"), "shingles", by="kind")
    known.destroy()  # written: nothing will be computed from it again
    sets = rows.where("kind = 'set'").groupBy("sig").agg(F.min("blob").alias("blob"), F.min("heads").alias("heads"))
    postings = rows.where("kind = 'key'").select("key", "sig", "n", "pos")
    owner = rows.where("kind = 'doc'").select("doc_id", "sig", "n")
    same = owner.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    if links:
        counted, groups = link_counts(postings, sets.join(same.select("sig", F.col("n_copies").alias("copies")), "sig"), percent)
        same = same.join(counted, "sig", "left")
    else:
        groups, same = components(linked_sets(postings, sets, percent)).select(F.col("id").alias("sig"), "root"), same.withColumn("n_links", F.lit(0))
    rooted = same.join(groups, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(low, "root").select(F.col("sig").alias("s"), "component_id", "n_copies", "n_links")
    out = owner.join(named, F.col("sig") == F.col("s"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce("n_copies", F.lit(1)) - 1).cast("long").alias("n_links"),
    )
    return out if links else out.drop("n_links")


def one_per_group(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is their component's: one document of each group stays."""
    (name,) = unused(docs, "keep")
    keep = similar_texts(spark, docs, k, percent, links=False).where("doc_id <=> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(by_shuffle(keep), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
