"""From raw documents to token files: five stages over the operators of newsloom.llm.

Every stage works on all rows that the one before it kept; each result is written as Parquet and read again. Rows with a
null in any column pass as the operators state it: null texts score as empty ones, near copies leaves rows without doc_id
alone, a null source is a source of its own. Empty tables give empty results; further columns go along until tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate as benchmark
from newsloom.llm import mixing, simhash, tokenfiles, toxicity
from newsloom.operators.shared import materialize


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; the model learns from labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.drop_toxic(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest doc_id, of every group of near copies."""
    return simhash.near_dedup(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return benchmark.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that every source comes near its target."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and describe every document as read back from them."""
    return tokenfiles.token_table(docs.select("doc_id", "text"), tokenfiles.default_tokenizer())


STAGES = [
    ("toxicity", toxic_out),
    ("near_copies", near_copies_out),
    ("benchmark", benchmark_out),
    ("mix", mixed),
    ("tokens", tokens),
]

#: The toxicity models and the tokenizer are beyond SQL; tests/llm/test_llm_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
