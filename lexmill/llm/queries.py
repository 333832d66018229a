"""Registered queries of the corpus operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codec, decontaminate, html_text, jaccard, licenses, oracles, pii, quality, token_counts, training_order, warc
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 512)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    layout = training_order.Layout.of(_vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))
    return training_order.materialised_order(table(spark, sf_dir, "documents"), layout)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), "contaminated")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ten = (op1_pii, op2_quality_rules, op3_token_counts, op4_training_order, op5_decontamination, op6_ngram_jaccard, op7_warc, op8_bpe_codec, op9_html_text, op10_license_scan)
    return {f.__name__: f for f in ten}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": oracles.quality_sql(), "op5_decontamination": oracles.DECONTAMINATION, "op7_warc": oracles.WARC}
