"""Operator 3, quality rules by suffix-array repetition.

The words of a slice of texts get dense numbers that differ between texts, so no repeat crosses a text. Prefix doubling
sorts the suffixes; only suffixes still tied are sorted again. Their ranks at each doubling give the longest common prefix of
neighbours. Each interval of the LCP array is a maximal repeated substring with its places; the union of all their
spans of at least m words is the union over suffixes of [i, i + longest LCP with a neighbour), where that is m or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import edges_of, importable, prefix_hash, slices, span_hash, two, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """Base limits, then the method's: repeats of ``repeat_words`` or more may cover ``most_covered`` of the words, and none may be longer than ``longest`` words.

    Published limits for repeated n-grams run from 0.15 down to 0.10; the lower one takes many more good documents than bad ones here.
    A passage of over 50 words that stands twice in a text is a repeat of its own.
    """

    least_words: int = 10
    window: int = 5
    most_repeated: float = 0.20
    repeat_words: int = 10
    most_covered: float = 0.15
    longest: int = 50


def longest_repeats(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word, the length in words of the longest substring from it on that occurs elsewhere in its row."""
    n = len(word)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.lexsort((word, row))
    fresh = np.ones(n, bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int32 if n < 1 << 31 else np.int64)  # one array a doubling is kept
    rank[order] = begin
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    tied = np.flatnonzero(~alone)
    sa, levels, h = order, [rank.copy()], 1
    while len(tied):
        part = sa[tied]
        key, after = rank[part], rank[np.minimum(part + h, n)]
        by = np.lexsort((after, key))
        part, key, after = part[by], key[by], after[by]
        sa[tied] = part
        fresh = np.ones(len(part), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (after[1:] != after[:-1])
        begin = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[part] = begin
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        tied = tied[~alone]
        levels.append(rank.copy())
        h *= 2
    a, b, lcp = sa[:-1], sa[1:], np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a[live] + lcp[live], n), np.minimum(b[live] + lcp[live], n)
        lcp[live] += (1 << k) * ((levels[k][x] == levels[k][y]) & (x < n) & (y < n))
    out[a] = lcp
    out[b] = np.maximum(out[b], lcp)
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Is each word in a repeat of at least ``least`` words?"""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:n]) > 0


def measures(data: np.ndarray, offs: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All figures of the rows of one slice."""
    n = len(offs) - 1
    a, b = words_of(data, offs)
    row = np.searchsorted(offs, a, "right") - 1
    s = prefix_hash(data)
    total = lambda w: np.bincount(row[w] if w.dtype == bool else row, weights=None if w.dtype == bool else w, minlength=n).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    words = np.bincount(row, minlength=n)
    longest = longest_repeats(span_hash(s, a, b), row)
    sums = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    la, lb = edges_of(data != 10, offs)
    spaces = np.concatenate([[0], np.cumsum(np.isin(data, (9, 11, 12, 13, 32)))])
    real = spaces[lb] - spaces[la] < lb - la
    la, lb = la[real], lb[real]
    lrow, lhash = np.searchsorted(offs, la, "right") - 1, span_hash(s, la, lb)
    by = np.lexsort((lhash, lrow))
    again = np.zeros(len(by), bool)
    again[1:] = (lrow[by][1:] == lrow[by][:-1]) & (lhash[by][1:] == lhash[by][:-1])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row, longest)
    return {
        "n_words": words, "word_chars": total((points[b] - points[a]).astype(float)), "n_symbols": sums[offs[1:]] - sums[offs[:-1]],
        "n_dup_lines": np.bincount(lrow[by][again], minlength=n), "n_repeat_words": total(covered(longest, rules.window)),
        "n_covered_words": total(covered(longest, rules.repeat_words)), "longest_repeat": top,
    }


def verdicts(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > round(100 * rules.most_repeated) * m["n_words"])
    method = (m["n_covered_words"] <= rules.most_covered * m["n_words"]) & (m["longest_repeat"] <= rules.longest)
    return failed, ~failed & method


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the figures (n_covered_words and longest_repeat are the method's), base_failed, kept.

    Null and empty texts have no words, so they fail; rows, repeated ones too, are judged each by itself.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            m = measures(data, offs, rules)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(m[k].astype(np.int64)) for k in FIGURES), *map(pa.array, verdicts(m, rules))], names=["doc_id", *FIGURES, "base_failed", "kept"])

    return two(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in FIGURES) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept; one pass, nothing is shuffled."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            yield rows.filter(pa.array(verdicts(measures(data, offs, rules), rules)[1]))

    return docs.mapInArrow(run, docs.schema)
