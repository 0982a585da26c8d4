"""The corpus pipeline: five stages that each take documents and hand on what they keep.

Toxic documents go; one document of each group of near copies stays; documents that hold a benchmark item go; the rest is
mixed to the target weights of its sources, a document as many times as it is taken; the mix is encoded and written as
token files, of which the last stage returns the digests. Every stage but the last returns the columns of documents.

Defined cases: null and empty texts are neither toxic nor near copies nor decontaminated, and have no words to be taken; rows
without an id pass the first three stages; rows of equal id and text are one document from the second stage on; texts are
read whole; further columns are handed on; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from logweave.llm.common import scratch, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.usable()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    tokens.write(docs, out, tokens.tokenizer_path())
    return tokens.describe(spark, out)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]
#: SQL can't express the trained model and the tokenizer; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
