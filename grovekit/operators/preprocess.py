"""Column operations of the preprocessing pipeline; ``Pipeline`` chains them in order into one lazy plan."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - min) / (max - min) over the table; a constant column gives NaN. One aggregate, its single row sent to all."""
    if not columns:
        return df
    stats = df.agg(*(f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, F.when(span == 0, F.lit(float("nan"))).otherwise((F.col(c).cast("double") - F.col(f"_lo_{c}")) / F.when(span != 0, span)))
    return out.select(*df.columns)


def number(c: Column) -> Column:
    """A cell as a number; what does not parse counts 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


@dataclass
class Pipeline:
    """Steps in call order; ``apply`` builds one plan, with an aggregate only where ``normalize`` asks for one."""

    steps: list[tuple] = field(default_factory=list)

    def clip(self, low: float, high: float, *columns: str) -> Pipeline:
        self.steps.append(("each", columns, lambda c: S.clip(c, low, high)))
        return self

    def log(self, *columns: str) -> Pipeline:
        self.steps.append(("each", columns, S.log10))
        return self

    def hash(self, *columns: str) -> Pipeline:
        self.steps.append(("each", columns, lambda c: S.string_hash(c.cast("string"))))
        return self

    def normalize(self, *columns: str) -> Pipeline:
        self.steps.append(("normalize", columns, None))
        return self

    def drop_empty(self, *columns: str) -> Pipeline:
        """Rows go in which a column is empty; without names, rows in which all are."""
        self.steps.append(("drop", columns, None))
        return self

    def select(self, *columns: str) -> Pipeline:
        """Ordered; repeats allowed, repeated names get a number."""
        self.steps.append(("select", columns, None))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for kind, columns, f in self.steps:
            if kind == "each":
                df = df.withColumns({c: f(F.col(c)) for c in columns})
            elif kind == "drop":
                empty = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in columns or df.columns]
                df = df.where(~reduce(operator.or_ if columns else operator.and_, empty))
            elif kind == "normalize":
                df = normalize(df, list(columns))
            else:
                seen: dict[str, int] = {}
                out = []
                for c in columns:
                    k = seen[c] = seen.get(c, 0) + 1
                    out.append((F.col(c) if c in df.columns else F.lit("")).alias(c if k == 1 else f"{c}_{k}"))
                df = df.select(*out)
        return df


def by_field(fields: list[int], every: Callable[[Column], Column], own: dict[int, Callable[[Column], Column]]) -> dict[int, Callable[[Column], Column]]:
    """The extractor of each field: its own one if there is one, else the one for every field."""
    return {i: own.get(i, every) for i in fields}


def normalize_points(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Min-max scaling of each dimension of an array column; dimensions are aggregated, not rows collected."""
    long = df.select(F.posexplode(vector).alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    row = stats.agg(F.sort_array(F.collect_list(F.struct("dim", "lo", "hi"))).alias("s"))  # as many entries as dimensions
    scale = F.transform(vector, lambda x, i: (x.cast("double") - F.col("s")[i]["lo"]) / F.nullif(F.col("s")[i]["hi"] - F.col("s")[i]["lo"], F.lit(0.0)))
    return df.crossJoin(F.broadcast(row)).select(id_col, scale.alias(vector))
