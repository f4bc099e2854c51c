"""Places in a total order and codes of sorted values, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def placed_within(rows: DataFrame, key: str, order: list[Column | str], name: str = "position", size: str | None = None) -> DataFrame:
    """rows with their place, from 0, among the rows of one key, and with that key's number of rows, if `size` names a column for it.

    Rows are sorted by ranges of key and order, so that a key with most rows is spread over the tasks, and stored; a row's place is that in
    its range plus the key's rows in the ranges before it. Of those counts there are no more than keys and ranges. No key may be null.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged).withColumn("_range", F.shiftright("_id", 33))
    shares = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    total = F.sum("_n").over(Window.partitionBy(key))
    shares = stored(shares.select(key, "_range", shift.alias("_shift"), total.alias("_total")))
    placed = ranged.join(shares, [key, "_range"])
    return placed.select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name), *([F.col("_total").alias(size)] if size else []))


def with_position(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """rows with their place, from 0, in a total order."""
    return placed_within(rows.withColumn("_all", F.lit(0)), "_all", order, name).drop("_all")


def coded(rows: DataFrame, column: str, name: str = "code") -> DataFrame:
    """rows with the place of their value among the sorted distinct values of a column, from 0; nulls come first."""
    codes = with_position(rows.select(F.col(column).alias("_value")).distinct(), [F.col("_value").asc_nulls_first()], name)
    return rows.join(codes, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def latest(rows: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The first n rows of an order: a report of so many."""
    return rows.orderBy(*order).limit(n)
