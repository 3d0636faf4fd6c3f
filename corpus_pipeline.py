"""From raw documents to shards: reject low quality, keep one of each group of near copies, take out documents that hold
test items, mix sources, languages and topics to their target weights, deal the rest into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm import decontaminate, mixing, ngram_join, quality, shard
from braidwork.llm.cluster import RowFilter, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.75 the document with the smallest doc_id stays. Rows without a
    doc_id stay. Only documents that may be on the list of those to go are shuffled with their texts."""
    joined = ngram_join.ngram_join(docs)
    gone = materialize(joined.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    sift = RowFilter(gone, "doc_id")
    maybe = sift.keep(docs, "doc_id").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return sift.keep(docs, "doc_id", present=False).unionAll(maybe)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard.shard_rows(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier cannot be said in SQL; the pipeline is tested stage by stage in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
