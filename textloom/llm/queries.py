"""The training-data queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language, line_dedup, near_dups, quality_model, quality_rules, substring_dedup, token_files, toxicity


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op1_token_files(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op2(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op3(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_documents(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs).drop("lang", "source")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op6(_table(spark, sf_dir, "documents"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicate_classes(_table(spark, sf_dir, "documents")).drop("node")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op10(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_dups": op9_near_dups,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": pipeline,
}

_OP6 = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM t WHERE len(w) >= 50
), hashed AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM wins
), first AS (
  SELECT h, min(doc_id) AS least FROM hashed GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hashed JOIN first USING (h) WHERE least < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op6_substring_dedup": _OP6, "op10_line_dedup": line_dedup.ORACLE}
