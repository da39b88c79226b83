"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, filter_audit, language, lexical_search, mixing, quality_rules, secret_scan, simhash, substring_dedup, token_count, token_store, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {
    "op1_benchmark_decontamination": lambda s, d: decontaminate.leak_report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op10_secret_scan": lambda s, d: secret_scan.secret_report(table(s, d, "documents")),
    "op11_filter_audit": lambda s, d: filter_audit.filter_audit(table(s, d, "documents"), table(s, d, "labels")),
    "op12_ranked_search": lambda s, d: lexical_search.ranked_search(table(s, d, "documents"), table(s, d, "benchmark")),
    "op13_quality_rules": lambda s, d: quality_rules.quality_rules(table(s, d, "documents")),
    "op2_token_counts": lambda s, d: token_count.token_counts(table(s, d, "documents")),
    "op3_language_id": lambda s, d: language.language_report(table(s, d, "documents")),
    "op4_exact_dedup": lambda s, d: exact_dedup.exact_dedup(table(s, d, "documents")),
    "op5_toxicity": lambda s, d: toxicity.toxicity_report(table(s, d, "documents"), table(s, d, "labels")),
    "op6_source_mixing": lambda s, d: mixing.calibrate(table(s, d, "documents")),
    "op7_token_store": lambda s, d: token_store.token_report(table(s, d, "documents")),
    "op8_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
    "op9_substring_dedup": lambda s, d: substring_dedup.repeat_report(table(s, d, "documents")),
}

SQL: dict[str, str] = {
    "op1_benchmark_decontamination": decontaminate.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_ranked_search": lexical_search.SQL,
    "op13_quality_rules": quality_rules.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_source_mixing": mixing.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
}
