"""The registered queries of the training-data operators: thin digests of their results, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recframe.llm.common import table
from recframe.llm.decontaminate import find_leaks
from recframe.llm.jaccard_join import jaccard_join
from recframe.llm.language import identify
from recframe.llm.licenses import scan_licenses
from recframe.llm.line_dedup import BOILERPLATE_SQL, drop_boilerplate
from recframe.llm.mixing import TAKEN_SQL, mix_digest
from recframe.llm.page_text import extract
from recframe.llm.quality import QUALITY_SQL, judge_quality
from recframe.llm.secrets import scan_secrets, secrets_sql
from recframe.llm.tokens import token_files


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def mix_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can follow of op4_mix_sources."""
    return op4_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def vocabulary() -> str:
    """The public tokenizer's file on this machine; each executor has the same path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scan, op3_decontaminate, op4_mix_sources, op5_quality_rules, op6_token_files, op7_language_id, op8_license_scan, op9_line_dedup, op10_page_text, mix_taken)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets_sql(), "mix_taken": TAKEN_SQL, "op5_quality_rules": QUALITY_SQL, "op9_line_dedup": BOILERPLATE_SQL}
