"""Operators on row order: ordinals, skips, limits in rows or bytes, splits, seeded shuffles.

A DataFrame has no order of its own, so these take order columns. Rows are dealt into ranges of the first order column, each
range is numbered by itself, and only the ranges' totals are summed up in one place.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def parse_size(text: str) -> int:
    """'10', '1_000', '5k', '2m', '1g' (powers of ten)."""
    m = re.fullmatch(r"([\d_]+)([kmg]?)", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1].replace("_", "")) * {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[m[2]]


def parse_ranges(text: str, inclusive: bool = False) -> list[int]:
    """'0,3,5-8': ranges end before their last number, or with it where ``inclusive``."""
    out: list[int] = []
    for part in text.split(","):
        a, _, b = part.strip().partition("-")
        out += range(int(a), int(b) + inclusive) if b else [int(a)]
    return out


def parse_seed(text: str) -> int:
    """An integer, or the 31-multiplier hash of any other text."""
    try:
        return int(text)
    except ValueError:
        h = 0
        for c in text:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h


def with_running(df: DataFrame, order: list[str], weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Adds _ord (from 0) and _sum (of ``weight`` over this and all earlier rows). The first order column is numeric."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(F.col(order[0]).cast("double"), F.array(*[F.lit((i + 1) / n) for i in range(n - 1)] or [F.lit(1.0)]), 10_000)).first()[0] or []
    cuts = sorted(set(cuts))[: n - 1]
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    df = df.withColumn("_part", part).withColumn("_w", (weight if weight is not None else F.lit(1)).cast("long"))
    totals = df.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_w").alias("_t"))  # as many rows as ranges
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_part").alias("_p"), "_n", "_t").select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"))
    w = Window.partitionBy("_part").orderBy(*order)
    out = df.join(F.broadcast(totals), F.col("_part") == F.col("_p"))
    return out.withColumn("_ord", F.col("_n0") + F.row_number().over(w) - 1).withColumn("_sum", F.col("_t0") + F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_part", "_p", "_w", "_n0", "_t0")


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("_ord", "_sum")


def skip(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return _plain(with_running(df, order).where(F.col("_ord") >= n))


def pick(df: DataFrame, order: list[str], ordinals: list[int]) -> DataFrame:
    return _plain(with_running(df, order).where(F.col("_ord").isin(ordinals)))


def limit_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows: a top-n, so no full sort."""
    return df.orderBy(*order).limit(n)


def limit_bytes(df: DataFrame, order: list[str], size: Column, most: int) -> DataFrame:
    """Rows while the bytes so far stay under ``most``."""
    return _plain(with_running(df, order, size).where(F.col("_sum") < most))


def limit_input(df: DataFrame, order: list[str], size: Column, lines: int | None = None, nbytes: int | None = None) -> DataFrame:
    """Both caps hold."""
    d = with_running(df, order, size)
    for cap, col in ((lines, F.col("_ord") + 1), (nbytes, F.col("_sum"))):
        d = d.where(col <= cap) if cap is not None else d
    return _plain(d)


def split_rows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds file_no: ``rows`` rows a file."""
    return with_running(df, order).withColumn("file_no", F.floor(F.col("_ord") / rows).cast("long")).drop("_ord", "_sum")


def _files_within(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of a range's sizes; for each row as a file's first, the next file's first row (or the end), and how many files begin after it and what the last one holds."""
    n = len(sizes)
    s = np.concatenate([[0], np.cumsum(sizes)])
    nonzero = np.minimum.accumulate(np.where(sizes > 0, np.arange(n), n)[::-1])[::-1]
    nxt = np.minimum(np.maximum(np.searchsorted(s[1:], s[:-1] + most, "left"), nonzero + 1), n)
    files, held = np.zeros(n, np.int64), s[-1] - s[:-1]
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            files[i], held[i] = files[nxt[i]] + 1, held[nxt[i]]
    return s, nxt, files, held


def _enter(s: np.ndarray, entry: int, most: int) -> int:
    """The first row that begins a file when ``entry`` bytes are held before the range; the number of rows if there is none."""
    n = len(s) - 1
    if not entry:
        return n
    return min(int(np.searchsorted(s[1:], most - entry, "left")), n)


def split_bytes(df: DataFrame, order: list[str], size: str, most: int, range_rows: int = 1 << 17) -> DataFrame:
    """Adds file_no: a new file starts where the file's bytes with the next row would reach ``most``.

    Where a file starts depends on every file before it. So each range of rows first reports what it does to whatever number of
    bytes is held when it begins: those are a few cases, since files that begin at different rows soon begin at the same ones. The
    driver follows these reports from range to range, then every range numbers its own rows.
    """
    d = with_running(df, order, F.col(size)).withColumn("_range", F.floor(F.col("_ord") / range_rows).cast("long"))
    narrow = cut(d.select("_range", "_ord", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")))

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        s, _, files, held = _files_within(pdf.sort_values("_ord")["_size"].to_numpy(), most)
        # held before: 0, or over most - s[j + 1] (and at most most - s[j]) where row j begins the first file; less than all: none does
        change = np.flatnonzero(np.concatenate([[True], (files[1:] != files[:-1]) | (held[1:] != held[:-1])]))
        last = np.append(change[1:], len(files)) - 1
        return pd.DataFrame([(int(pdf["_range"].iloc[0]), int(s[-1]), int(files[0]), int(held[0]), (most - s[last + 1]).tolist(), (files[change] + 1).tolist(), held[change].tolist())], columns=["r", "total", "files", "held", "least", "then_files", "then_held"])

    reports = narrow.groupBy("_range").applyInPandas(report, "r long, total long, files long, held long, least array<long>, then_files array<long>, then_held array<long>")
    held, number, begin = 0, 0, {}
    for r in reports.orderBy("r").toLocalIterator():  # a row a range
        begin[r["r"]] = (held, number)
        case = next((i for i, least in enumerate(r["least"]) if held >= least), None) if held else None
        if not held:
            number, held = number + r["files"], r["held"]
        elif case is None:
            held += r["total"]
        else:
            number, held = number + r["then_files"][case], r["then_held"][case]
    known = df.sparkSession.sparkContext.broadcast(begin)

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord")
        s, nxt, _, _ = _files_within(pdf["_size"].to_numpy(), most)
        entry, no = known.value[int(pdf["_range"].iloc[0])]
        out, at = np.full(len(pdf), no, np.int64), _enter(s, entry, most) if entry else 0
        while at < len(pdf):
            no += bool(entry or at)
            out[at : int(nxt[at])] = no
            at = int(nxt[at])
        return pd.DataFrame({"_o": pdf["_ord"], "file_no": out})

    numbered = narrow.groupBy("_range").applyInPandas(name, "_o long, file_no long")
    return _plain(d.join(numbered, F.col("_ord") == F.col("_o")).drop("_o", "_range"))


def limit_files(lines: DataFrame, files: int) -> DataFrame:
    """Lines of the first ``files`` files in the order of their names."""
    first = lines.select("file").distinct().orderBy("file").limit(files).select(F.col("file").alias("_f"))
    return lines.join(F.broadcast(first), F.col("file") == F.col("_f"), "left_semi")  # as many rows as the limit


def shuffle(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """A seeded permutation: rows in the order of the MD5 of seed and key."""
    return df.withColumn("_k", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))).orderBy("_k", *key).drop("_k")
