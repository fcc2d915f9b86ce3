"""A corpus pipeline of four stages over ``documents``; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import exact_dedup, ngram_join, packing, quality
from tidegauge.llm.common import scratch_path, table
from tidegauge.llm.queries import tokenizer_path

#: SQL can't express the classifier or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links: five words, 0.8 or more."""
    return ngram_join.drop_similar(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep.

    Each stage is written to the shared folder and read again. Null texts count as empty;
    an empty table gives an empty result; how each stage treats nulls, ties and repeated
    rows stands with its operator.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = scratch_path(spark, "pipeline")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
