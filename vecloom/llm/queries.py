"""The queries of this subpackage, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.sharding import extendible_shards

    return extendible_shards(_read(spark, sf_dir, "documents"))


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.quality import score_quality

    return score_quality(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.mixing import mix_report

    return mix_report(_read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vecloom.llm.bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vecloom.llm.lm import score_texts

    return score_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.pages import extract_pages

    return extract_pages(_read(spark, sf_dir, "pages"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.vectors import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.urls import judge_urls

    return judge_urls(_read(spark, sf_dir, "pages"))


def op10_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vecloom.llm.store import store_report

    return store_report(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.boost import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.trie import prefix_trie

    return prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.audit import audit_filters

    return audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_extendible_sharding, op2_repetition_coverage, op3_ngram_jaccard, op4_source_mixing, op5_byte_bpe, op6_attention_scores, op7_template_deduction, op8_projection_forest, op9_url_globs, op10_content_store, op11_boosted_quality, op12_prefix_trie, op13_filter_audit, pipeline)}


def oracle_sql() -> dict[str, str]:
    from vecloom.llm import audit, mixing, sharding, trie, urls

    return {"op1_extendible_sharding": sharding.ORACLE_SQL, "op4_source_mixing": mixing.ORACLE_SQL, "op9_url_globs": urls.ORACLE_SQL, "op12_prefix_trie": trie.ORACLE_SQL, "op13_filter_audit": audit.oracle_sql()}
