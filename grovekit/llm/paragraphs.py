"""Operator 2, substring dedup by paragraph MinHash banding.

Paragraphs are a text's lines with a word. Each is its set of word shingles; equal sets count once. Signatures of
``bands`` x ``rows`` minima are cut into bands; at similarity 0.8 a pair collides in some band with probability
1 - (1 - 0.8**4)**14 = 0.9994. Only band values that two paragraphs have are listed; colliding paragraphs are verified by exact
Jaccard, and of each component the first paragraph (by doc_id, then place) stays.

Passages also sit inside longer paragraphs. So every sentence is looked up verbatim, as a paragraph of its own that needs no
bands; runs of sentences that occur earlier go where they have ``least_run`` words or more together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, U64, Scratch, Table, by_shuffle, edges_of, free, importable, mix, pack, prefix_hash, quick_hash, row_bounds, shingle_sets, slices, span_hash, words_of
from .sharing import components, key32, linked_sets, set_ids, shared_keys

BANDS, ROWS = 14, 4
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Lines = tuple[np.ndarray, np.ndarray, np.ndarray]


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[Lines, Words]:
    """Start, end (bytes in the slice) and quick hash of each line with a word; start, end, hash and line of each word."""
    sums = prefix_hash(_lower(data))
    a, b = words_of(data, offs)
    start, end = edges_of(data != 10, offs)
    line = np.searchsorted(start, a, "right") - 1
    real = np.zeros(len(start), bool)
    real[line] = True
    start, end = start[real], end[real]
    return (start, end, quick_hash(sums, start, end)), (a, b, span_hash(sums, a, b), (np.cumsum(real) - 1)[line])


def _paragraphs(words: Words, lines: int, k: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The lines' shingle sets one after the other, and the bounds between these."""
    return shingle_sets(words[2], row_bounds(words[3], lines), k, ordered)


def _different(flat: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sets differ from all before them; these sets and their bounds."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))  # stable: the first of equal ones leads
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]).any(1)
    one, size = np.sort(order[new]), np.diff(at)
    use = np.zeros(len(size), bool)
    use[one] = True
    return one, flat[np.repeat(use, size)], np.concatenate([[0], np.cumsum(size[one])])


def _sentences(data: np.ndarray, offs: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end, words and 128-bit hash (two columns) of each sentence: words up to one that ends in . or ?, or the line's end."""
    a, b, h, line = words
    if not len(a):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros((0, 2), U64)
    final = data[b - 1]
    last = (final == 46) | (final == 63)
    last[:-1] |= line[1:] != line[:-1]
    last[-1] = True
    j = np.flatnonzero(last)
    i = np.concatenate([[0], j[:-1] + 1])
    both = []
    for seed in (1, 2):
        power = np.cumprod(np.full(len(h), _SEEDS[seed]))
        inverse = np.cumprod(np.full(len(h), U64(pow(int(_SEEDS[seed]), -1, 1 << 64))))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(seed)) * power)])
        both.append(mix((total[j + 1] - total[i]) * inverse[i] + (j - i).astype(U64)))
    return np.searchsorted(offs, a[i], "right") - 1, a[i], b[j], j - i + 1, np.stack(both, 1)


def bands_of(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, BANDS) band values of sets that lie one after the other, none empty; multiply-shift permutations of the hashes, minima over each set."""
    start = at[:-1]
    out = np.zeros((len(start), BANDS), U64)
    if not len(start):
        return out
    for band in range(BANDS):
        v = np.full(len(start), band + 1, U64)
        for r in range(ROWS):
            v = mix(v * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(flat * _SEEDS[band * ROWS + r], start))
        out[:, band] = v
    return out


_STORED = {"kind": pa.string(), "doc_id": pa.int64(), "h": pa.int64(), "start": pa.int64(), "end": pa.int64(), "sig": pa.binary(), "n": pa.int32(), "key": pa.int64()}


def _stored(kind: str, rows: int, /, **cols: pa.Array | np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; columns that it doesn't have are null."""
    cols["kind"] = pa.repeat(kind, rows)
    return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c not in cols else pa.array(cols[c], t) if isinstance(cols[c], np.ndarray) else cols[c] for c, t in _STORED.items()], names=list(_STORED))


def _binaries(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """The numbers' bytes, cut at ``at`` (counted in numbers)."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(pack((at * 8).astype(np.int32))), pa.py_buffer(pack(x))])


def _ids(x: np.ndarray) -> pa.Array:
    return _binaries(x, np.arange(len(x) + 1) * 2)


def _sets(docs: DataFrame, sigs: DataFrame, k: int) -> DataFrame:
    """sig and blob of all paragraphs whose set is one of ``sigs`` (sig and h, the quick hash of a line that has it), and of a few more.

    Texts are read again for it: most sets that have a band value twice share no list with a different set, and would be written in vain.
    Only lines whose hash is listed are cut into words again.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield key32(batch.column(0).to_numpy().view(U64))

    known = shared_keys(sigs.select("h"), keys, 1 / 8, least=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in slices(batches):
            start, end = edges_of(data != 10, offs)
            use = known.shared(key32(quick_hash(prefix_hash(_lower(data), quick=True), start, end)))
            start, end = start[use], end[use]
            at = np.concatenate([[0], np.cumsum(end - start)])
            data = data[np.arange(at[-1]) + np.repeat(start - at[:-1], end - start)]
            lines, words = _words(data, at)
            flat, at = _paragraphs(words, len(lines[0]), k, ordered=True)
            ids = set_ids(flat, at)
            one, flat, at = _different(flat, at, ids)
            yield pa.RecordBatch.from_arrays([_ids(ids[one]), _binaries(flat, at)], names=["sig", "blob"])

    return docs.select("text").mapInArrow(run, "sig binary, blob binary").groupBy("sig").agg(F.min("blob").alias("blob"))


def paragraph_clusters(spark: SparkSession, docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, least_sentence: int = 4) -> DataFrame:
    """A row for each paragraph: doc_id, h (hash of the text), start, end (bytes), sig, n, root, and unit (line, or sentence where another text may have it).

    root is what a paragraph's component shares: the least set id in it, for a sentence its hash.
    """
    importable(spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, data, offs in slices(batches):
            lines, words = _words(data, offs)
            flat, at = _paragraphs(words, len(lines[0]), k)
            _, flat, at = _different(flat, at, set_ids(flat, at))
            _, _, _, n, sentence = _sentences(data, offs, words)
            yield np.concatenate([key32(bands_of(flat, at).reshape(-1)), key32(sentence[n >= least_sentence, 0])])

    known = shared_keys(docs, keys, 0.05)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            doc, h = rows.column(0), rows.column(rows.schema.get_field_index("h"))
            (a, b, quick), words = _words(data, offs)
            flat, at = _paragraphs(words, len(a), k)
            row = np.searchsorted(offs, a, "right") - 1
            sig, size = set_ids(flat, at), np.diff(at)
            yield _stored("line", len(row), doc_id=doc.take(pa.array(row)), h=h.take(pa.array(row)), start=a - offs[row], end=b - offs[row], sig=_ids(sig), n=size)
            one, flat, at = _different(flat, at, sig)
            bands = bands_of(flat, at)
            use = known.shared(key32(bands.reshape(-1))).reshape(bands.shape)
            i, band = np.nonzero(use)
            yield _stored("key", len(i), h=quick[one[i]].view(np.int64), sig=_ids(sig[one[i]]), n=size[one[i]], key=bands[i, band].view(np.int64))
            row, a, b, n, sentence = _sentences(data, offs, words)
            again = np.flatnonzero((n >= least_sentence) & known.shared(key32(sentence[:, 0])))
            row, a, b = row[again], a[again], b[again]
            yield _stored("sentence", len(row), doc_id=doc.take(pa.array(row)), h=h.take(pa.array(row)), start=a - offs[row], end=b - offs[row], sig=_ids(sentence[again]), n=n[again])

    stored = scratch.table(docs.mapInArrow(run, "kind string, doc_id long, h long, start long, end long, sig binary, n int, key long"), "paragraphs", by="kind")
    known.destroy()  # written: nothing will be computed from it again
    free(spark)
    postings = stored.where("kind = 'key'").select("key", "sig", "n", F.lit(0).alias("pos"))
    lines = stored.where("kind = 'key'").groupBy("sig").agg(F.min("h").alias("h"))

    def listed(sigs: DataFrame) -> DataFrame:
        return _sets(docs, scratch.table(lines.join(sigs, "sig"), "listed"), k)

    groups = components(linked_sets(postings, listed, percent)).select(F.col("id").alias("s"), "root")
    unit = stored.where("kind IN ('line', 'sentence')").select(F.col("kind").alias("unit"), "doc_id", "h", "start", "end", "sig", "n")
    return unit.join(groups, F.col("sig") == F.col("s"), "left").drop("s").withColumn("root", F.coalesce("root", "sig"))


def _repeated(spark: SparkSession, docs: DataFrame, k: int, percent: int, least_words: int) -> DataFrame:
    """doc_id, h and the spans with a copy elsewhere: place, unit, words, is it the first, and the doc_id that has the first."""
    words = F.when(F.col("unit") == "line", F.col("n") + F.lit(k - 1)).otherwise(F.col("n"))
    with Scratch() as scratch:
        return Table(_spans(paragraph_clusters(spark, docs, scratch, k, percent).withColumn("words", words).where((F.col("unit") == "sentence") | (F.col("words") >= least_words)), scratch), "repeated-paragraphs").read()


def _spans(units: DataFrame, scratch: Scratch) -> DataFrame:
    place = F.struct("doc_id", "h", "start")
    units = scratch.table(units, "units")  # a side of its own, so that a unit in a third of all documents can be split
    first = units.groupBy("unit", "root").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("unit").alias("u"), F.col("root").alias("r"), "first")
    met = units.join(first, (F.col("unit") == F.col("u")) & (F.col("root") == F.col("r")))
    span = F.struct(F.col("start").alias("a"), F.col("end").alias("b"), F.col("unit").alias("unit"), F.col("words").alias("words"), (place == F.col("first")).alias("first"), F.col("first.doc_id").alias("kept_in"))
    return met.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def _decide(spans: list[dict], least_run: int) -> tuple[list[tuple[int, int]], set[int], int]:
    """Byte spans to remove, the doc_ids that keep them, and how many paragraphs have a copy, first ones included."""
    lines = sorted((x["a"], x["b"]) for x in spans if x["unit"] == "line" and not x["first"])  # lines do not overlap
    starts, whole = [a for a, _ in lines], list(lines)
    inside = lambda x: (k := bisect_right(starts, x["a"]) - 1) >= 0 and x["b"] <= whole[k][1]
    into = {x["kept_in"] for x in spans if x["unit"] == "line" and not x["first"]}
    copied = sum(x["unit"] == "line" for x in spans)
    run: list[dict] = []

    def close() -> None:
        nonlocal copied
        if sum(x["words"] for x in run) >= least_run:
            copied += 1
            if gone := [x for x in run if not x["first"]]:
                lines.extend((x["a"], x["b"]) for x in gone)
                into.update(x["kept_in"] for x in gone)
        run.clear()

    for x in (x for x in spans if x["unit"] == "sentence" and not inside(x)):
        if run and x["a"] > run[-1]["b"] + 1:
            close()
        run.append(x)
    close()
    return sorted(set(lines)), into, copied


def paragraph_report(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, least_words: int = 10, least_run: int = 20) -> DataFrame:
    """doc_id, n_bytes, n_paragraphs, n_repeated (paragraphs with a copy, kept ones too), n_removed (spans), removed_bytes, kept_in (doc_ids that keep them), kept_text per row.

    A paragraph of fewer than ``least_words`` words never goes (sets of n shingles stand for n + k - 1 words).
    Null texts count as empty: nothing goes; repeated rows count as one text, a copy under another doc_id loses its paragraphs;
    ties go to the lower doc_id, null first, then the earlier place; an empty table gives no rows.
    """
    importable(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.col("text").cast("string")
    gone = _repeated(spark, docs.select(key.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")), k, percent, least_words)
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "spans")
    joined = docs.select("doc_id", text.alias("text")).join(by_shuffle(gone), (key == F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            out = []
            a, b = edges_of(data != 10, offs)
            words = np.concatenate([[0], np.cumsum(~SPACE[data])])
            n_lines = np.diff(row_bounds(np.searchsorted(offs, a[words[b] > words[a]], "right") - 1, len(offs) - 1)).tolist()
            for i, spans in enumerate(rows.column(2).to_pylist()):
                raw, at, kept = data[offs[i] : offs[i + 1]].tobytes(), 0, []
                spans, into, copied = _decide(spans or [], least_run)
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = max(at, min(b + 1, len(raw)))  # with the line end or space after it
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((len(raw), n_lines[i], copied, len(spans), len(raw) - len(kept), sorted(into), kept.decode(errors="ignore")))
            n, lines, copied, k_, size, into, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, lines, copied, k_, size)), pa.array(into, pa.list_(pa.int64())), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_paragraphs", "n_repeated", "n_removed", "removed_bytes", "kept_in", "kept_text"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_paragraphs long, n_repeated long, n_removed long, removed_bytes long, kept_in array<long>, kept_text string")
