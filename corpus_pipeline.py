"""A corpus from raw documents: quality rules, near-dedup, repeated passages, mix, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next one's docs.  All but the last return the columns of
documents; the mix adds mix_slot, its order, which the tokens keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import bpe, minhash_dedup, mixing, quality_rules, substring_dedup
from groundwork.llm.common import bound_batches, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the standard policy."""
    bound_batches(spark)
    return quality_rules.reject_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (five words, similarity 0.8)."""
    bound_batches(spark)
    return minhash_dedup.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that an earlier text has."""
    bound_batches(spark)
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the weighted mix, with their slot in it."""
    bound_batches(spark)
    return mixing.mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, with the slot."""
    bound_batches(spark)
    keep = [c for c in ("doc_id", "source", "mix_slot") if c in docs.columns]
    return bpe.tokenized(docs.select(*keep, "text")).select(*keep, *bpe.digests())


STAGES = [("quality_rules", quality), ("minhash_dedup", near_dedup), ("substring_dedup", substrings), ("mixing", mix), ("bpe", tokens)]

#: SQL can express neither the schedule nor the tokens; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
