"""The training-data pipeline: language ID, line dedup, near-duplicate removal,
benchmark decontamination, byte-level BPE.

Each stage is written as Parquet to a shared folder and read again, so a lost
executor costs one stage at most.  Documents whose lines are all repeats go with
the line dedup; texts that were empty at its input stay there, but the language
stage before it rejects them already.  Each stage starts with small heaps: those that
the one before has grown go back to the system.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, decontaminate, language, line_dedup, near_dups
from textloom.llm.common import materialize, shrink_heaps


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    model = language.fit(docs, ~language.held_out(docs, 4, 2))
    return language.keep_identified(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return line_dedup.drop_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return near_dups.keep_representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return bpe.digests(coded)


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dups", dedup_near),
    ("decontaminate", drop_benchmark),
    ("byte_bpe", encode),
]

#: The CRF and ProbMinHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
