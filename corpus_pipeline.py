"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet into the shared folder
and rereads them as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import bpe, decontaminate, line_dedup, quality, similar
from noteloom.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model rejects go, each by its own text; null and empty ones, which show nothing, stay."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three-line windows go; n_chars follows the text. A document with nothing left goes; null and empty texts that lost nothing stay."""
    out, removed = line_dedup.line_dedup(docs), F.col(line_dedup.count_names(docs.columns)[1])
    out = out.where((removed == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays; so do rows without a doc_id. Null and empty texts are alike."""
    return similar.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, each by its own text; null and empty ones stay."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, a row for each row; null counts as empty."""
    return bpe.encode_decode(docs, bpe.default_path())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near duplicates", near_duplicate_stage), ("benchmark", benchmark_stage), ("tokens", token_stage)]

#: The model, the windows and the tokenizer aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
