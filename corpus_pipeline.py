"""A training corpus from `documents`: five stages, each written as Parquet and reread as the next one's docs.

When a stage starts, it first drops what former stages have stored on the way, unless docs still reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasift.llm import bpe_tree, jaccard_join, line_runs, pareto_mix, toxicity
from terrasift.llm.common import Scratch, table_path
from terrasift.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity, by labels outside the held-out fold."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten different texts or more go, but no row: copies are the next stage's. n_chars follows the text."""
    from pyspark.sql import functions as F

    out = line_runs.without_shared_lines(docs, by_text=True)
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return pareto_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    return bpe_tree.digests(docs, tokenizer_path())


_scratch = Scratch()


def alone(stage: Stage) -> Stage:
    """A stage that first drops what former ones stored on their way, and docs, once written, does not read."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.drop(docs)
        return _scratch.of(lambda: stage(spark, docs, sf_dir))

    return run


STAGES = [
    ("toxicity", alone(drop_toxic)),
    ("line_dedup", alone(drop_shared_lines)),
    ("ngram_jaccard_join", alone(keep_one_of_each)),
    ("mixing", alone(mix_sources)),
    ("bpe", alone(encode)),
]

#: The first stage learns a model, which SQL can't express: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = table_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
