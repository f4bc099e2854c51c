"""Thresholds on account limits, and alerts with a cooldown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: minutes between two alerts where a threshold names none, or 0.
COOLDOWN = 30


def breaches(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, provider, account, window, value, limit_value, breached): thresholds fit an account by provider (null: any) and account (*: any).

    values: provider, account, window, value. The join is on the window; the rest is tested. Thresholds are a written list. With a column
    cooldown_minutes in thresholds, it is there too.
    """
    more = [c for c in ("cooldown_minutes",) if c in thresholds.columns]
    t = thresholds.select("name", "window", F.col("provider").alias("_p"), F.col("account").alias("_a"), F.col("limit_value"), F.coalesce("alert", F.lit(True)).alias("_on"), *more)
    fits = (F.col("_p").isNull() | (F.col("_p") == F.col("provider"))) & ((F.col("_a") == "*") | (F.col("_a") == F.col("account")))
    over = F.coalesce(F.col("_on") & (F.col("value") >= F.col("limit_value")), F.lit(False))
    return values.join(t, "window").filter(fits).select("name", "provider", "account", "window", "value", "limit_value", over.alias("breached"), *more)


def to_send(breaches: DataFrame, accounts: DataFrame, now: int, log: DataFrame) -> DataFrame:
    """(ts, name, account, provider, window, value, limit_value): the breaches that are an alert now.

    None of suspended or stale accounts (accounts: provider, account, status, stale), and none within cooldown_minutes of the last alert of
    its name and account in log (ts, name, account).
    """
    alive = accounts.filter((F.col("status") != "suspended") & ~F.col("stale")).select("provider", "account")
    last = log.groupBy("name", "account").agg(F.max("ts").alias("_last"))
    rows = breaches.filter("breached").join(alive, ["provider", "account"], "left_semi").join(last, ["name", "account"], "left")
    wait = F.coalesce(F.nullif("cooldown_minutes", F.lit(0)), F.lit(COOLDOWN)) * 60_000
    due = rows.filter(F.col("_last").isNull() | (F.lit(now) - F.col("_last") >= wait))
    return due.select(F.lit(now).alias("ts"), "name", "account", "provider", "window", "value", "limit_value")


def _cooled(rows: pd.DataFrame) -> pd.DataFrame:
    rows, keep, last = rows.sort_values("ts"), [], None
    for ts, minutes in zip(rows["ts"], rows["cooldown_minutes"], strict=True):
        sent = last is None or ts - last >= (minutes or COOLDOWN) * 60_000
        last = ts if sent else last
        keep.append(sent)
    return rows[keep]


def with_cooldown(alerts: DataFrame) -> DataFrame:
    """The alerts that are sent: none within cooldown_minutes (0: 30) of the last one sent for its name and account.

    A group has the alerts of one threshold on one account, which the cadence of snapshots bounds.
    """
    return alerts.groupBy("name", "account").applyInPandas(_cooled, alerts.schema)
