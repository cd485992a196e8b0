"""A corpus pipeline of five stages, each one operator of the llm subpackage.

run() writes each stage's rows as Parquet into the folder that spark.checkpoint.dir names and reads them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialforge.llm import decontam, langid, packing, quality, simhash
from trialforge.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or whose source is rejected go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of ambiguous language go."""
    return langid.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece."""
    return packing.best_fit_pack(docs, kept_words=30_000)  # workers of the stages before still hold memory


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the learned stages nor the packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


#: Whole texts go to Python in batches of so many rows, so that a worker holds a few megabytes of them.
ROWS_PER_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "400")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name, rows = ROWS_PER_BATCH
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(name, before)
    return docs
