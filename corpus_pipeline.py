"""From documents to token ids: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again for the next. All stages read
whole texts of any length, take nulls in any column, and give an empty table for an empty table; columns may have any further names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geneframe.llm import bpe, minhash, mixture, pii, quality
from geneframe.llm.common import table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts don't; repeated rows are judged alike, and there are no ties."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id, null last; of repeated rows one. Texts without a word stay."""
    return minhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in text replaced. Null and empty texts stay as they are; repeated rows are handled alike."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is one of its own. Equal rows share what is taken of them by their hash."""
    return mixture.resampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document; null or empty text has none, repeated rows and null ids have a row each."""
    return bpe.encoded(docs).select("doc_id", "n_tokens", "ids")


STAGES = [("quality_rules", rules), ("minhash_near_dedup", near_duplicates), ("pii", personal_data), ("mixing", mix), ("byte_bpe", encode)]

#: Near-duplicate components and BPE merges can't be said in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
