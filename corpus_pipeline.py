"""The corpus pipeline: toxic documents out, cross-site lines out, one of each group of near copies, benchmark passages out, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``. Texts of documents may be changed by a stage, never their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomdiff.functions.stage import written
from roomdiff.llm import decontaminate, lines, minhash, pieces, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxicity is a half or more go. The model is fitted on the labelled documents of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sites go from all documents but the first that has them. No document goes."""
    return lines.cleaned(docs, counts=False)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 or more, the one with the smallest id stays."""
    return minhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of test items go; a document goes if no other words are in it."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with whether they agree with the sentencepiece library and decode to the text."""
    return pieces.encode(docs)


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("minhash", near_stage), ("decontamination", benchmark_stage), ("sentencepiece", token_stage)]

# The first stage is a fitted model and the third MinHash groups: SQL cannot say them. tests/llm/test_pipeline.py holds every stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
