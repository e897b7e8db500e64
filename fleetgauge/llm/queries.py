"""The dealt operators on the supplied tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm import (
    decontamination,
    language_id,
    main_text,
    mixing,
    near_duplicates,
    passages,
    periodic_runs,
    personal_data,
    quality,
    quality_model,
    repeated_strings,
    statements,
    url_filters,
    whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), shingle=4)


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, folder, "documents"))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_table(spark, folder, "documents"))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(_table(spark, folder, "pages"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"))


def op6_shared_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.shared_passages(_table(spark, folder, "documents"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, folder, "pages"))


def op9_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return repeated_strings.digest(repeated_strings.cut_repeats(docs, repeated_strings.repeated_spans(docs)))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontamination.contamination(decontamination.find_passages(docs, benchmark))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_tails(_table(spark, folder, "documents"))))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.rate_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


OPERATORS = [
    op1_minhash_near_duplicates, op2_personal_data, op3_source_mixing, op4_main_text, op5_quality_rules,
    op6_shared_passages, op7_language_id, op8_url_filters, op9_repeated_strings, op10_benchmark_decontamination,
    op11_embedding_whitening, op12_periodic_runs, op13_quality_classifier,
]


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def llm_oracles() -> dict[str, str]:
    return {"op1_minhash_near_duplicates": statements.NEAR_DUPLICATES, "op9_repeated_strings": statements.REPEATED_STRINGS,
            "op10_benchmark_decontamination": statements.DECONTAMINATION}
