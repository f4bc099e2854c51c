"""Rolling windows up to a given time, in one pass over the turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000
#: Fixed values, in seconds: a node's report is fresh so long, and a session is live so long after its last turn, by what is known of its process.
NODE_STALE, ALIVE_IDLE, UNKNOWN_IDLE = 900, 3600, 360


def starts(as_of: int, windows: dict[str, int], not_before: int = 0) -> dict[str, int]:
    return {name: max(as_of - hours * HOUR, not_before) for name, hours in windows.items()}


def rolling(turns: DataFrame, keys: list[str], as_of: int, windows: dict[str, int], measures: dict[str, Column], not_before: int = 0, among: DataFrame | None = None) -> DataFrame:
    """(keys, <measure>_<window>..., turns_<window>...): sums over the turns since as_of minus the window; later turns count too.

    Only turns of the longest window are read. A key without any has no row, but where `among` names the keys (distinct): then its sums are 0.
    """
    since = starts(as_of, windows, not_before)
    inside = {name: F.col("ts") >= start for name, start in since.items()}
    aggs = []
    for name, test in inside.items():
        aggs += [F.sum(F.when(test, m)).alias(f"{c}_{name}") for c, m in measures.items()]
        aggs.append(F.count_if(test).alias(f"turns_{name}"))
    out = turns.filter(F.col("ts") >= min(since.values())).groupBy(*keys).agg(*aggs)
    if among is not None:
        renamed = out.select(*(F.col(k).alias(f"_{k}") for k in keys), *out.columns[len(keys) :])
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        out = among.select(*keys).join(renamed, same, "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c not in keys and not c.startswith("_")))


def share_of_limit(utilization: Column, own: Column, total: Column) -> Column:
    """The part of an account's use of its limit that is a session's; null where a factor is null or 0."""
    return F.nullif(utilization, F.lit(0)) * own / F.nullif(total, F.lit(0))


def limits_of(accounts: DataFrame) -> DataFrame:
    """(provider, account, window, utilization) of folded accounts: what each limit that an account reports is used by; a key without a utilization is no limit."""
    each = accounts.select("provider", F.col("email").alias("account"), F.explode("rate_limits").alias("window", "_limit"))
    return each.select("provider", "account", "window", F.col("_limit.utilization").alias("utilization")).filter("utilization is not null")


def shares_of_limits(sessions: DataFrame, windows: list[str], limits: DataFrame, metric: str = "total") -> DataFrame:
    """(provider, account, session_id, window, <metric>, share): of session windows (`rolling` by session), the part of the account's limit in each window
    that is a session's, by its part of the account's use in that window; null without a limit."""
    each = F.array(*(F.struct(F.lit(w).alias("window"), F.col(f"{metric}_{w}").alias(metric)) for w in windows))
    rows = sessions.select("provider", "account", "session_id", F.explode(each).alias("_w")).select("provider", "account", "session_id", "_w.*")
    every = rows.groupBy("provider", "account", "window").agg(F.sum(metric).alias("_all")).join(limits, ["provider", "account", "window"], "left")
    share = share_of_limit(F.col("utilization"), F.col(metric), F.col("_all"))
    return rows.join(every, ["provider", "account", "window"]).select("provider", "account", "session_id", "window", metric, share.alias("share"))


def live(now: int, updated: Column, reported: Column, pid_alive: Column, stale_s: int = NODE_STALE, alive_s: int = ALIVE_IDLE, unknown_s: int = UNKNOWN_IDLE) -> Column:
    """Its node has reported, and it was busy lately: within an hour if its process is known to be alive, else within minutes."""
    idle = F.lit(now) - updated
    busy = F.when(pid_alive == 1, idle <= alive_s * 1000).when(pid_alive.isNull(), idle <= unknown_s * 1000).otherwise(False)
    return F.coalesce((F.lit(now) - reported <= stale_s * 1000) & busy, F.lit(False))
