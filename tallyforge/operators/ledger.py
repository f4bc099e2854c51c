"""The turn ledger: each turn once, without bursts of replayed ones, and what it adds up to for each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by `order` (arrival for "first wins", the timestamp for "earliest wins"); order must be total.

    A minimum over structs, not a window: it is summed up before the shuffle, so copies do not pile up in a task.
    """
    rest = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return rows.groupBy(key).agg(first.alias("_row")).select(key, "_row.*").select(*rows.columns)


def burst_seconds(rows: DataFrame, least: int, where: Column, keys: list[str]) -> DataFrame:
    """(keys, second) with `least` rows or more of one whole second; found before any other filter. A null time is 0, and null keys are a group."""
    return rows.filter(where).groupBy(*keys, _second().alias("second")).count().filter(F.col("count") >= least).drop("count")


def _second() -> Column:
    return F.floor(F.coalesce("ts", F.lit(0)) / 1000)


def without_bursts(rows: DataFrame, least: int, where: Column, keys: list[str]) -> DataFrame:
    found = burst_seconds(rows, least, where, keys)
    bursts = found.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("second").alias("_second"), F.lit(True).alias("_burst"))
    same = F.col("second") == F.col("_second")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    marked = rows.withColumn("second", _second()).join(bursts, same, "left")
    return marked.filter(F.col("_burst").isNull() | ~where).select(*rows.columns)


def provable(rows: DataFrame) -> DataFrame:
    """Rows with an id and an account that are not assumed."""
    return rows.filter(F.col("uuid").isNotNull() & ~F.coalesce(F.col("assumed"), F.lit(False)) & F.col("account_email").isNotNull())


def session_totals(turns: DataFrame, order: tuple[str, ...] = ("ts", "uuid"), last: tuple[str, ...] = ("account", "host", "cwd"), sets: tuple[str, ...] = ("model",)) -> DataFrame:
    """One row per (provider, session): sums, first and last time, last known values by `order` and sets; turns without a session stand alone."""
    key = F.coalesce(F.nullif("session_id", F.lit("")), F.concat(F.lit("_"), "uuid"))
    at = F.struct(*order)
    return turns.groupBy("provider", key.alias("session_id")).agg(
        F.count("*").alias("turns"),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("i", "o", "cw", "cr")),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in last),
        *(F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias(f"{c}s") for c in sets),
    )
