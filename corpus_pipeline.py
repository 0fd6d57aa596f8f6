"""The training-data pipeline: language ID, near duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recframe.llm.common import materialise, table
from recframe.llm.decontaminate import drop_leaks
from recframe.llm.jaccard_join import drop_near_copies
from recframe.llm.language import keep_identified
from recframe.llm.mixing import mix
from recframe.llm.queries import vocabulary
from recframe.llm.tokens import token_files


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard links stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source is taken to its target: a document stands in the mix 0 to 2 times, shuffled within its shard."""
    return mix(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, in the order that mixing gave it, and what is read back from them of each document."""
    return token_files(docs, vocabulary(), ordered=False)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing), ("token-ID / binary output", token_output)]

#: Expectation-maximisation, MinHash, SimHash and a seeded splitting tree aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
