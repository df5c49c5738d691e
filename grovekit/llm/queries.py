"""The registered queries of this subpackage; each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, media, ngram_join, packing, paragraphs, pieces, repair, repetition, rollup, substrings, templates, topk, trie


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(spark, _read(spark, sf_dir, "documents"), k=3, percent=90)


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = paragraphs.paragraph_report(spark, _read(spark, sf_dir, "documents"))
    return report.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(_read(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_output(spark, _read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_report(_read(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(spark, _read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents by two counting versions, toxic documents deleted, low-quality ones revised to distinct words; one replay."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = _read(spark, sf_dir, "labels")
    roll = rollup.TokenRollup(spark)
    base = docs.select("doc_id", "source", "lang", rollup.count_words(F.col("text")).alias("words"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    both = base.select("doc_id", "source", "lang", F.explode(F.create_map(F.lit("words-1"), F.col("words"), F.lit("bytes-1"), F.col("bytes"))).alias("tokenizer_version", "tokens"))
    roll.apply("000-load", both.withColumn("op", F.lit("insert")))
    gone = labels.where("toxic = 1").select("doc_id").distinct()
    gone = gone.select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.explode(F.array(F.lit("words-1"), F.lit("bytes-1"))).alias("tokenizer_version"), F.lit(0).cast("long").alias("tokens"), F.lit("delete").alias("op"))
    roll.apply("001-takedown", gone)
    low = labels.where("quality = 0 AND toxic = 0").select(F.col("doc_id").alias("d")).distinct()
    kinds = F.size(F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), rollup.WS), lambda w: w != ""))).cast("long")
    counted = docs.select("doc_id", "source", "lang", kinds.alias("tokens"))  # before the join, so that no text is shuffled
    revised = counted.join(low, F.col("doc_id") == F.col("d")).select("doc_id", "source", "lang", F.lit("words-1").alias("tokenizer_version"), "tokens", F.lit("revise").alias("op"))
    roll.apply("002-revision", revised)
    roll.apply("001-takedown", gone)
    return roll.totals()


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(spark, _read(spark, sf_dir, "documents"), length=400, passage=200)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(spark, _read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark, _read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark, _read(spark, sf_dir, "conversations"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, _read(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max(toxic) AS toxic, bool_or(quality = 0 AND toxic = 0) AS low FROM labels GROUP BY doc_id),
live AS (SELECT d.*, coalesce(l.low, false) AS low FROM d LEFT JOIN l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1),
w AS (SELECT source, lang, low, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM live)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*)::BIGINT AS n_docs,
       sum(CASE WHEN low THEN len(list_distinct(words)) ELSE len(words) END)::BIGINT AS n_tokens FROM w GROUP BY ALL
UNION ALL
SELECT source, lang, 'bytes-1', count(*)::BIGINT, sum(strlen(text))::BIGINT FROM w GROUP BY ALL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_output": op4_token_output,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_media_columns": op7_media_columns,
    "op8_token_counts": op8_token_counts,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_topk": op13_exact_topk,
}
SQL: dict[str, str] = {"op6_line_dedup": templates.SQL, "op8_token_counts": OP8_SQL}
