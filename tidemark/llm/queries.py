"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, lang_id, line_dedup, packing, pieces, quality_rules, shingle_join, simhash, substring_dedup, zstd_quality
from .common import table


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.report(table(spark, sf_dir, "documents"), public_tokenizers.path(pieces.MODEL))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_class_lm": op1_class_lm,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_id": op4_language_id,
        "op8_packing": op8_packing,
        "op9_pieces": op9_pieces,
        "op10_compression_quality": op10_compression_quality,
        "op2_line_dedup": op2_line_dedup,
        "op5_simhash": op5_simhash,
        "op6_shingle_join": op6_shingle_join,
        "op7_quality_rules": op7_quality_rules,
    }
