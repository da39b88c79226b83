"""The corpus pipeline: five stages, each one operator of ``quarrydex.llm``.

Each stage reads what its predecessor wrote as Parquet.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrydex.llm import decontaminate, mixing, simhash, token_store, toxicity
from quarrydex.llm.base import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that don't score as toxic; nulls, repeated rows, missing labels and clashing column names as in ``toxicity.drop_toxic``."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id.  Rows without an id stay, texts without words are alike, rows that share an id stay or go together; columns may have any further names."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of ``benchmark``; texts without words stay; nulls, repeats, empty tables and clashing column names as in ``decontaminate.decontaminate``."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights; null sources and languages are values of their own, texts without words are always drawn, rows that share an id share the draw."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token store; a null text is empty, each repeated row has its own recipe, an empty table gives no rows."""
    return token_store.token_report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_store", write_tokens),
]

#: A trained model decides in the first stage, which SQL can't express; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; the stages in between are written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
