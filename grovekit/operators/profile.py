"""Column profiles, schema inference and input statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of all cells as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: cells, empty, unknown (?), integers, doubles, strings, longest text."""
    v = F.col("value")
    empty, unknown = v.isNull() | (v == ""), v == "?"
    whole = v.rlike("^[+-]?[0-9]+$")
    real = v.try_cast("double").isNotNull() & ~whole
    rest = ~empty & ~unknown
    return stacked(df, columns).groupBy("column").agg(
        F.count("*").alias("cells"), F.count_if(empty).alias("n_empty"), F.count_if(F.coalesce(unknown, F.lit(False))).alias("n_unknown"),
        F.count_if(rest & whole).alias("n_integer"), F.count_if(rest & real).alias("n_double"), F.count_if(rest & ~whole & ~real).alias("n_string"),
        F.coalesce(F.max(F.length("value")), F.lit(0)).cast("long").alias("max_length"),
    )


def number_range(df: DataFrame, columns: list[str]) -> DataFrame:
    x = F.col("value").try_cast("double")
    return stacked(df, columns).groupBy("column").agg(F.min(x).alias("min_number"), F.max(x).alias("max_number"))


def top_values(df: DataFrame, columns: list[str], k: int = 30) -> DataFrame:
    """The k most frequent values of each column; counts are summed before they are ranked."""
    counts = stacked(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def inferred_schema(df: DataFrame, columns: list[str], enum_below: int = 100) -> DataFrame:
    """Per column: enum (few distinct values, no doubles), real, integer or string."""
    distinct = stacked(df, columns).where("value IS NOT NULL AND value <> '' AND value <> '?'").groupBy("column").agg(F.countDistinct("value").alias("n_distinct"))
    t = types(df, columns).join(distinct, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    kind = F.when((F.col("n_distinct") < enum_below) & (F.col("n_double") == 0), "enum").when((F.col("n_double") > 0) & (F.col("n_string") == 0), "real").when((F.col("n_integer") > 0) & (F.col("n_string") == 0), "integer").otherwise("string")
    return t.select("column", "n_distinct", kind.alias("kind"))


def range_stats(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Per column: min, max, and how many values lie beyond [low, high]."""
    x = F.col("value").try_cast("double")
    return stacked(df, columns).groupBy("column").agg(F.min(x).alias("lowest"), F.max(x).alias("highest"), F.count_if(x < low).alias("below"), F.count_if(x > high).alias("above"))


def line_stats(df: DataFrame, text: str) -> DataFrame:
    """lines, empty_lines, longest (bytes with the line end)."""
    return df.agg(F.count("*").alias("lines"), F.count_if(F.coalesce(F.col(text), F.lit("")) == "").alias("empty_lines"), F.max(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("longest"))


def consecutive(df: DataFrame, group: list[str], order: list[str], distance: Column, vector: str, every: int = 1, seconds: int = 0) -> DataFrame:
    """Distance of each row to the one before it in its group, for every n-th row, or for the first one of each stretch of ``seconds`` (by the first order column, a timestamp). ``distance`` uses ``vector`` and _previous."""
    w = Window.partitionBy(*group).orderBy(*order)
    if seconds:  # the first row of each stretch of time
        at = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(order[0]).cast("timestamp_ntz")) / seconds)
        d = df.withColumn("_previous", F.lag(vector).over(w)).withColumn("_n", at).withColumn("_m", F.lag(at).over(w))
        return d.where(F.col("_previous").isNotNull() & (F.col("_n") != F.col("_m"))).withColumn("distance", distance).drop("_previous", "_n", "_m")
    d = df.withColumn("_previous", F.lag(vector).over(w)).withColumn("_n", F.row_number().over(w))
    return d.where(F.col("_previous").isNotNull() & (F.col("_n") % every == 0)).withColumn("distance", distance).drop("_previous", "_n")
