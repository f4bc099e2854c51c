"""Who a session belongs to: pins, then the first fitting rule of an ordered list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import glob

#: Rules tried on every row; of a longer list, all rules are tried on the distinct combinations of what they look at.
ON_ROWS = 200


def _first_fitting(rules: list, cwd: str, host: str, provider: str) -> Column:
    """The owner by the first fitting rule of a list; the patterns are literals, so each is compiled once in a task."""
    out = None
    for r in rules:
        tests = [(r.re, F.col(cwd).rlike(r.re) if r.re else None), (r.host, F.col(host) == r.host), (r.provider, F.col(provider) == r.provider)]
        fits = [F.coalesce(test, F.lit(False)) for condition, test in tests if condition is not None]
        if fits:
            every = fits[0]
            for f in fits[1:]:
                every = every & f
            out = F.when(every, F.lit(r.owner)) if out is None else out.when(every, F.lit(r.owner))
    return F.lit(None).cast("string") if out is None else out


def first_match(rows: DataFrame, rules: DataFrame, cwd: str = "cwd", host: str = "host", provider: str = "provider") -> DataFrame:
    """rows with owner (null if no rule fits). rules: rule_idx, owner, cwd_glob, host, provider; a rule without any condition never fits.

    Rules are a list that someone has written, and go to the driver; rows are not moved for up to ON_ROWS of them.
    """
    every = rules.orderBy("rule_idx").select("owner", glob(F.col("cwd_glob")).alias("re"), "host", "provider").collect()
    blocks = [every[i : i + ON_ROWS] for i in range(0, len(every), ON_ROWS)] or [[]]
    owner = F.coalesce(*(_first_fitting(b, cwd, host, provider) for b in blocks))
    if len(blocks) == 1:
        return rows.withColumn("owner", owner)
    keys = [cwd, host, provider]
    kinds = rows.select(*keys).distinct().withColumn("owner", owner)
    kinds = kinds.select("owner", *(F.col(k).alias(f"_kind_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_kind_{k}"))
    return rows.drop("owner").join(kinds, same, "left").drop(*(f"_kind_{k}" for k in keys))


def owners(sessions: DataFrame, rules: DataFrame, pins: DataFrame, launch: str = "launch_cwd") -> DataFrame:
    """sessions with owner: a pin, else the rules on cwd, else the rules on the path it was launched from."""
    by_cwd = first_match(sessions, rules).withColumnRenamed("owner", "_by_cwd")
    both = first_match(by_cwd, rules, cwd=launch).withColumnRenamed("owner", "_by_launch")
    pinned = pins.select("session_id", F.col("owner").alias("_pin"))
    return both.join(pinned, "session_id", "left").withColumn("owner", F.coalesce("_pin", "_by_cwd", "_by_launch")).drop("_pin", "_by_cwd", "_by_launch")


def tracked(provider: Column, account: Column, allowed: list[str], excluded: list[str]) -> Column:
    """In the allow-list (an empty one allows all) and not in the deny-list of provider:account."""
    ok = account.isin(*allowed) if allowed else F.lit(True)
    return ok & ~F.concat_ws(":", provider, account).isin(*excluded) if excluded else ok
