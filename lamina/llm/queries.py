"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.tokens import token_counts

    return token_counts(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.quality import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.substrings import passages

    return passages(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.packing import pack

    return pack(documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=4)


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.pieces import encode

    return encode(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.rules import judge

    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.markup import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.fingerprint import against_next

    return against_next(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_classifier,
        op3_license_scan,
        op4_substring_dedup,
        op5_packing,
        op6_near_dedup,
        op7_sentence_pieces,
        op8_quality_rules,
        op9_html_text,
        op10_fingerprints,
    )
}
