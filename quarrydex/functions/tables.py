"""Helpers on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_row(one: DataFrame) -> Column:
    """The one row of an aggregate as a struct column: a scalar subquery, not a join."""
    return one.select(F.struct(*one.columns).alias("x")).scalar()


def beside(left: DataFrame, *others: DataFrame) -> DataFrame:
    """``left`` with the columns of tables of one row."""
    for k, other in enumerate(others):
        left = left.withColumn(f"_one{k}", only_row(other))
    return left.select(*[c for c in left.columns if not c.startswith("_one")], *[F.col(f"_one{k}.{c}").alias(c) for k, other in enumerate(others) for c in other.columns])
