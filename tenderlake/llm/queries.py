"""Queries of the corpus operators over the given tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import (byte_bpe, conversation_trie, decontamination, html_extraction, minhash_dedup, oracle, quality_rules, secret_scans,
                            sharding, substring_dedup, suffix_dedup, toxicity, url_filters, vector_codes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """Rank file and pattern of the byte-level vocabulary, by default those of the installed public files."""
    import public_tokenizers

    return byte_bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.redacted(table(spark, sf_dir, "documents"))
    changed = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("redacted_sha256")
    return found.select("doc_id", "n_candidates", "n_secrets", changed)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(table(spark, sf_dir, "pages"))


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", kept, "duplicated")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality,
        "op2_decontamination": decontaminated,
        "op3_secret_scans": secrets,
        "op4_url_filters": urls,
        "op5_html_extraction": main_texts,
        "op6_suffix_dedup": suffixes,
        "op7_toxicity": toxic,
        "op8_substring_dedup": chunked,
        "op9_byte_bpe": encoded,
        "op10_minhash_dedup": near_duplicates,
        "op11_vector_codes": codes,
        "op12_conversation_trie": trie,
        "op13_sharding": shards,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.QUERIES)
