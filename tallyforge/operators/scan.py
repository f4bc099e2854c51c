"""Ordered series of very uneven length: cut into segments by ranges of key and order, summed up, and combined over the segments of a key.

A window by key puts all rows of a key into one task. Here rows are sorted by ranges of (key, order), so a key with a third of all rows lies in
a third of the ranges; what a fold needs of the rows before a segment is a small state, and states are combined over segments, of which a key
has no more than there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

SEGMENT, AT = "_segment", "_at"


def segmented(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """rows, stored, with their segment and, rising within a key, their place. A key's segments are numbered in order; none spans two tasks.

    There are as many ranges as a shuffle has partitions: small ones are not put together, for folds are work for each row.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    return stored(ranged.withColumn(AT, F.monotonically_increasing_id()).withColumn(SEGMENT, F.shiftright(AT, 33)))


def local(keys: list[str]) -> Window:
    """The rows of a segment, in order."""
    return Window.partitionBy(*keys, SEGMENT).orderBy(AT)


def earlier(keys: list[str]) -> Window:
    """The segments of a key before this one; a row of each."""
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def previous(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(SEGMENT)


def with_carried(parts: DataFrame, keys: list[str], states: DataFrame, how: str = "inner") -> DataFrame:
    """parts with the other columns of states, of which each segment has one row at most; by its size the table is sent or joined."""
    more = [c for c in states.columns if c not in [*keys, SEGMENT]]
    renamed = states.select(*(F.col(c).alias(f"_{c}_of_state") for c in [*keys, SEGMENT]), *more)
    same = F.col(SEGMENT) == F.col(f"_{SEGMENT}_of_state")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_of_state"))
    return parts.join(renamed, same, how).drop(*(f"_{c}_of_state" for c in [*keys, SEGMENT]))
