"""A corpus pipeline: each stage takes the documents its predecessor kept and works on all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierlens.llm import decontamination, language_id, mixing, sharding, simhash_dedup
from tierlens.llm.tables import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined; the model is learned from the labelled documents."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates (five-word shingles, similarity 0.8)."""
    return simhash_dedup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source to its target: whole epochs, then a sample weighted by text quality."""
    return mixing.mix_rows(docs, quality=mixing.text_quality())


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the mix into 40 shards of the same composition; adds shard and slot."""
    return sharding.shard_rows(docs, 40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# a learned model and hashes outside SQL decide the first stages; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each is written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir.rstrip("/")))
    return STAGES[-1][1](spark, docs, sf_dir.rstrip("/"))
