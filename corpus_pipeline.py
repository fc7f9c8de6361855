"""The corpus pipeline: five stages over the documents, each written as Parquet and reread as the next one's documents.

Every stage works on all that its predecessor kept, and all but the last return the columns of ``documents``. No SQL
expresses the near-duplicate, suffix-array and packing stages, so there is no ORACLE_SQL; the tests hold the result
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, packing, quality_rules, shingle_join, substring_dedup
from tidemark.llm.common import saved, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go from all of them."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, Jaccard similarity of 0.8 or more."""
    return shingle_join.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document holds go."""
    return substring_dedup.cut_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("shingle_join", near_duplicates),
    ("suffix_dedup", passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
