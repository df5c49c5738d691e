"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage gets what its predecessor kept, written as Parquet and read again. The first four return the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovekit.llm import common, ngram_join, packing, repetition, substrings, templates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition limits reject go."""
    return repetition.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for the first."""
    return templates.drop_recurring(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, similarity 0.8."""
    return ngram_join.one_per_group(spark, docs, k=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes or more that occur elsewhere go: a passage of 50 words is hardly shorter."""
    return substrings.without_repeats(spark, docs, length=200, shallow=33)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into as few sequences as the method finds."""
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express suffix sorting and packing; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the cluster's shared folder and goes once the next is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES[:-1]:
        written = common.Table(f(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = written.read(), written
    return STAGES[-1][1](spark, docs, sf_dir)
