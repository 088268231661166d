"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasift.llm import sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import jaccard_join

    return jaccard_join.joined(documents(spark, sf_dir), k=4, num=85, den=100)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import recurrent_lm

    return recurrent_lm.scored(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import line_runs

    return line_runs.digests(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import pareto_mix

    return pareto_mix.allocated(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import dom_boost

    return dom_boost.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import toxicity

    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import quality_cascade

    return quality_cascade.judged(documents(spark, sf_dir)).drop("rules_run")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import fingerprints

    return fingerprints.with_next(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import bpe_tree

    return bpe_tree.digests(documents(spark, sf_dir), tokenizer_path())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasift.llm import pii_bootstrap

    return pii_bootstrap.digests(documents(spark, sf_dir))


OPERATORS = (
    op1_ngram_jaccard_join, op2_lm_scoring, op3_line_dedup, op4_mixing, op5_html_extraction,
    op6_toxicity, op7_quality_rules, op8_fingerprints, op9_bpe, op10_pii,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    have = queries()
    return {k: v for k, v in sql.ORACLES.items() if k in have}
