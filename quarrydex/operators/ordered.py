"""Values along an order, by segments: no group's rows need to meet in one task, however large a share it has.

The order is cut into segments of time (or of a number).  Windows run within a group's segment; what a segment comes to, its
first and last value, its sum and its least running sum, is a row, and only those rows are put in one order for each group.
What goes before a segment is then joined to its rows, which stay where the windows left them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Length of a segment: seconds of a time, or the unit of a number.
SEGMENT = 86_400


def _local(order: list[str]):
    return Window.partitionBy("_key", "_segment").orderBy(*order)


def _segments():
    return Window.partitionBy("_key").orderBy("_segment")


def _earlier():
    return _segments().rowsBetween(Window.unboundedPreceding, -1)


def _cut(rows: DataFrame, by: list[str], order: list[str], segment: int) -> DataFrame:
    """``rows`` with the group's key, never null, and the segment of the first column of ``order``; a null order comes first."""
    at = F.col(order[0])
    place = at / F.lit(segment) if isinstance(rows.schema[order[0]].dataType, NumericType) else F.unix_micros(at.cast("timestamp")) / F.lit(segment * 1_000_000)
    # "=" before each value, so that null and the empty string differ
    key = F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by])
    return rows.withColumns({"_key": key, "_segment": F.coalesce(F.floor(place).cast("bigint"), F.lit(-(1 << 63)))})


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def _join(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.join(carried, ["_key", "_segment"], "left")


def following(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with ``out``: ``value`` of the group's next row, null for the last one.  ``value`` isn't null where there is a next row."""
    own = _cut(rows, by, order, segment)
    first = own.groupBy("_key", "_segment").agg(F.min_by(value, _order(order)).alias("_first"))
    carried = first.select("_key", "_segment", F.lead("_first").over(_segments()).alias("_carried"))
    own = own.withColumn(out, F.lead(value).over(_local(order)))
    return _join(own, carried).withColumn(out, F.coalesce(out, "_carried")).drop("_key", "_segment", "_carried")


def preceding(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with ``out``: ``value`` of the group's row before, null for the first one."""
    own = _cut(rows, by, order, segment)
    last = own.groupBy("_key", "_segment").agg(F.max_by(value, _order(order)).alias("_last"))
    carried = last.select("_key", "_segment", F.lag("_last").over(_segments()).alias("_carried"))
    local = _local(order)
    own = own.withColumns({out: F.lag(value).over(local), "_nth": F.row_number().over(local)})
    return _join(own, carried).withColumn(out, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col(out))).drop("_key", "_segment", "_carried", "_nth")


def latest(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with ``out``: the last ``value`` of the group that isn't null, up to and with the row."""
    own = _cut(rows, by, order, segment)
    last = own.where(F.col(value).isNotNull()).groupBy("_key", "_segment").agg(F.max_by(value, _order(order)).alias("_last"))
    segments = own.select("_key", "_segment").distinct().join(last, ["_key", "_segment"], "left")
    carried = segments.select("_key", "_segment", F.last("_last", True).over(_earlier()).alias("_carried"))
    own = own.withColumn(out, F.last(value, True).over(_local(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return _join(own, carried).withColumn(out, F.coalesce(out, "_carried")).drop("_key", "_segment", "_carried")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, floor: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` up to and with the row; with ``floor`` 0 a count that never falls below 0.

    A floored count is the running sum minus its least value so far, where that is negative; over segments, sums add up and the
    least value is the least of (sum before the segment + its own least).
    """
    own = _cut(rows, by, order, segment)
    # equal orders get one place after the other, as the sum of a row doesn't have its equals in it
    local = _local(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_sum", F.sum(value).over(local))
    own = own.withColumn("_least", F.min("_sum").over(local))
    parts = own.groupBy("_key", "_segment").agg(F.sum(value).alias("_total"), F.min("_sum").alias("_low"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_total").over(_earlier()), F.lit(0)))
    carried = parts.select("_key", "_segment", "_before", F.min(F.col("_before") + F.col("_low")).over(_earlier()).alias("_low"))
    total = F.col("_before") + F.col("_sum")
    if floor is not None:
        total = total - F.least(F.lit(floor), F.col("_before") + F.col("_least"), F.col("_low"))
    return _join(own, carried).withColumn(out, total).drop("_key", "_segment", "_sum", "_least", "_before", "_low")
