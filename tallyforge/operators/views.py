"""What the ledger shows at a time: accounts, sessions, people, and what they cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import WHOLE, priced
from .attribution import owners, tracked
from .report import UNASSIGNED
from .rollup import measure_sums, priceable
from .windows import live, rolling

#: An account's use is stale after an hour, and an error of one reader is none if another succeeded later than half an hour before it.
STALE_MS, GRACE_MS = 3_600_000, 1_800_000
NO_AUTH = ("unauthorized", "auth_error")


def account_status(provider: Column, email: Column, status: Column, status_at: Column, fetched_at: Column, forced: dict[str, str]) -> Column:
    """The status forced for provider:email, else for the e-mail; else auth_error, unless a success came at about that time or later; else ok."""
    known = F.create_map(*(F.lit(x) for kv in forced.items() for x in kv)) if forced else F.create_map().cast("map<string,string>")
    failed = F.coalesce(status.isin(*NO_AUTH), F.lit(False))
    excused = F.coalesce((fetched_at > 0) & (status_at > 0) & (fetched_at >= status_at - GRACE_MS), F.lit(False))
    return F.coalesce(known[F.concat_ws(":", provider, email)], known[email], F.when(failed & ~excused, "auth_error").otherwise("ok"))


def stale(fetched_at: Column, now: int) -> Column:
    return F.coalesce((fetched_at > 0) & (F.lit(now) - fetched_at > STALE_MS), F.lit(False))


def with_unreported(accounts: DataFrame, allowed: list[str], providers: list[str], forced: dict[str, str]) -> DataFrame:
    """accounts, and those of the allow-list that have never reported but have a status forced for provider:email; their other columns are null."""
    rows = [(p, e) for e in sorted(set(allowed)) for p in providers if f"{p}:{e}" in forced]
    wanted = accounts.sparkSession.createDataFrame(rows, "provider string, account string")
    absent = wanted.join(accounts.select("provider", "account"), ["provider", "account"], "left_anti")
    return accounts.unionByName(absent, allowMissingColumns=True)


def account_view(accounts: DataFrame, turns: DataFrame, totals: DataFrame, meta: DataFrame, now: int, windows: dict[str, int], measures: dict[str, Column], count_from: int = 0, live_s: int = 360) -> DataFrame:
    """accounts (provider, account, ...) with the sums of each window, lifetime sums, and the hosts seen ever and lately, sorted."""
    keys = ["provider", "account"]
    use = rolling(turns, keys, now, windows, measures, count_from, accounts.select(*keys))
    life = totals.groupBy(*keys).agg(F.sum("turns").alias("life_turns"), F.sum(F.expr("i + o + cw + cr")).alias("life_tokens"), F.array_sort(F.collect_set("host")).alias("hosts"))
    lately = meta.filter(F.coalesce("updated_at", F.lit(0)) >= now - live_s * 1000).groupBy(*keys).agg(F.array_sort(F.collect_set("host")).alias("live_hosts"))
    none = F.array().cast("array<string>")
    out = accounts.join(use, keys, "left").join(life, keys, "left").join(lately, keys, "left")
    return out.withColumns({"life_turns": F.coalesce("life_turns", F.lit(0)), "life_tokens": F.coalesce("life_tokens", F.lit(0)), "hosts": F.coalesce("hosts", none), "live_hosts": F.coalesce("live_hosts", none)})


def session_view(totals: DataFrame, meta: DataFrame, nodes: DataFrame, now: int, rules: DataFrame, pins: DataFrame, allowed: list[str], excluded: list[str], **idle: int) -> DataFrame:
    """One row per session of totals: what is known of it from its turns, else from meta; live; owner; and tracked (others are left out of lists, not of sums).

    meta: (provider, session_id, host, account, cwd, pid_alive, updated_at, status, started_at); nodes: (host, last_report).
    """
    m = meta.select("provider", "session_id", *(F.col(c).alias(f"_{c}") for c in ("host", "account", "cwd", "pid_alive", "updated_at", "status", "started_at")))
    rows = totals.join(m, ["provider", "session_id"], "left")
    rows = rows.withColumns({c: F.coalesce(c, f"_{c}") for c in ("host", "account", "cwd")}).withColumn("launch_cwd", F.col("_cwd"))
    rows = rows.join(nodes.select("host", F.col("last_report").alias("_report")), "host", "left")
    zero = F.lit(0)
    rows = rows.withColumn("updated", F.greatest(F.coalesce("last_ts", zero), F.coalesce("_updated_at", zero)))
    rows = rows.withColumn("live", live(now, F.col("updated"), F.coalesce("_report", zero), F.col("_pid_alive"), **idle))
    rows = rows.withColumn("status", F.coalesce("_status", F.lit("active"))).withColumn("started_at", F.coalesce("first_ts", "_started_at"))
    rows = rows.withColumn("tracked", F.coalesce(tracked(F.col("provider"), F.col("account"), allowed, excluded), F.lit(False)))
    keep = [*totals.columns, "updated", "live", "status", "started_at", "tracked", "launch_cwd"]
    return owners(rows.select(*keep), rules, pins).withColumn("owner", F.coalesce("owner", F.lit(UNASSIGNED))).drop("launch_cwd")


def session_order() -> list[Column]:
    return [F.desc_nulls_last("last_ts"), F.asc("provider"), F.asc("session_id")]


def found_in(text: str, *fields: Column) -> Column:
    """Whether any of the fields contains the text, whatever the case."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(f), F.lit(text.lower())), F.lit(False)) for f in fields))


def owned(turns: DataFrame, sessions: DataFrame, unassigned: str = UNASSIGNED) -> DataFrame:
    """turns, or groups of them, with the owner of their session; that of an unknown session is unassigned.

    Untracked sessions have owners too: their turns may be on a tracked account.
    """
    own = sessions.select(F.col("provider").alias("_p"), F.col("session_id").alias("_s"), F.col("owner").alias("_owner"))
    joined = turns.join(own, (F.col("provider") == F.col("_p")) & (F.col("session_id") == F.col("_s")), "left")
    return joined.withColumn("owner", F.coalesce("_owner", F.lit(unassigned))).drop("_p", "_s", "_owner")


def people(sessions: DataFrame) -> DataFrame:
    """One row per owner of tracked sessions: lifetime sums, live sessions, and sorted sets of providers, hosts and accounts."""
    return sessions.filter("tracked").groupBy("owner").agg(
        *(F.sum(c).alias(c) for c in ("turns", "i", "o", "cw", "cr")),
        F.count_if("live").alias("live_sessions"),
        *(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("provider", "host", "account")),
    )


def person_windows(turns: DataFrame, sessions: DataFrame, now: int, windows: dict[str, int], measures: dict[str, Column], by_account: bool = False) -> DataFrame:
    """(owner, and provider and account if by_account): the sums of each window. Turns are summed up by session before they meet their owners."""
    grain = rolling(turns, ["provider", "account", "session_id"], now, windows, measures)
    sums = [c for c in grain.columns if c not in ("provider", "account", "session_id")]
    return owned(grain, sessions).groupBy("owner", *(("provider", "account") if by_account else ())).agg(*(F.sum(c).alias(c) for c in sums))


def account_pivot(breakdown: DataFrame, windows: list[str], metric: str) -> DataFrame:
    """Of person_windows by account: a person's accounts with use in any window, the one with most use of the last window first."""
    some = reduce(lambda a, b: a | b, (F.col(f"{metric}_{w}") > 0 for w in windows))
    return breakdown.filter(some).select("owner", "provider", "account", *(f"{metric}_{w}" for w in windows)).orderBy("owner", F.desc(f"{metric}_{windows[-1]}"), "provider", "account")


def window_costs(turns: DataFrame, sessions: DataFrame, now: int, windows: dict[str, int], long_context_over: int, long_context: Column, card: DataFrame, speeds: DataFrame, lc_rates: DataFrame, split_ttl: Column) -> DataFrame:
    """The turns of each window (its name, its hours up to now), priced: (window, owner, provider, account, model, speed, effort, lc, n, part, tokens, rate, reason).

    One pass for all windows: a turn is summed up under the shortest window that holds it, by session and price, and the sums are repeated for the
    longer ones. Long contexts are told turn by turn. Groups without tokens are left out; turns without
    tokens count where their group has others with some.
    """
    keys = ["provider", "account", "session_id", "model", "speed", "effort", "lc"]
    ordered = sorted(windows, key=windows.get)
    since = {w: now - windows[w] * 3_600_000 for w in ordered}
    shortest = F.coalesce(*(F.when(F.col("ts") >= since[w], F.lit(k)) for k, w in enumerate(ordered)))
    rows = turns.filter(F.col("ts") >= since[ordered[-1]]).withColumn("_w", shortest)
    grain = priceable(rows, long_context_over, long_context).groupBy("_w", *keys).agg(*measure_sums())
    names = F.array(*map(F.lit, ordered))
    own = owned(grain, sessions).withColumn("_split", split_ttl).withColumn("window", F.explode(F.slice(names, F.col("_w") + 1, len(ordered))))
    own = own.groupBy("window", "owner", *(k for k in keys if k != "session_id"), "_split").agg(*(F.sum(c).alias(c) for c in ("n", "i", "o", "cw", "cr", "cw1h", "cwu"))).filter("i + o + cw + cr > 0")
    return priced(own, card, speeds, lc_rates, F.col("_split"), whole=True).drop("i", "o", "cw", "cr", "cw1h", "cwu", "_split")


def _money() -> Column:
    return F.coalesce(F.sum(F.col("tokens").cast("decimal(20,0)") * F.col("rate")), F.lit(0)).cast("decimal(38,6)")


def _with_pct(rows: DataFrame) -> DataFrame:
    """pct: 1/100 percent of the owner's money in a window, 0 where there is none."""
    everything = F.sum("microdollars").over(Window.partitionBy("window", "owner"))
    # A quotient of decimals would be rounded to six places first, and from there up.
    share = F.col("microdollars").cast("double") * 10_000 / F.nullif(everything, F.lit(0)).cast("double")
    return rows.withColumn("pct", F.coalesce(F.round(share), F.lit(0)).cast("bigint"))


def owner_costs(costs: DataFrame) -> DataFrame:
    """(window, owner, microdollars) of window_costs, those who cost most first."""
    return costs.filter(F.col("part") != WHOLE).groupBy("window", "owner").agg(_money().alias("microdollars")).orderBy("window", F.desc("microdollars"), "owner")


GROUP = ["provider", "account", "model", "speed", "effort", "lc"]


def cost_groups(costs: DataFrame) -> DataFrame:
    """Of window_costs: (window, owner, provider, account, model, speed, effort, lc): turns, priced tokens, microdollars, pct, and `parts`, what each part
    with a rate has and costs; groups without any rate are in `unpriced`."""
    part = F.col("part") != WHOLE
    rated = part & F.col("rate").isNotNull()
    cost = (F.col("tokens").cast("decimal(20,0)") * F.col("rate")).cast("decimal(38,6)")
    each = F.array_sort(F.collect_list(F.when(rated, F.struct("part", "tokens", cost.alias("microdollars")))))
    groups = costs.filter(part | F.col("reason").isNull()).groupBy("window", "owner", *GROUP).agg(
        F.coalesce(F.sum(F.when(~part, F.col("n"))), F.lit(0)).alias("turns"), F.coalesce(F.sum(F.when(rated, F.col("tokens"))), F.lit(0)).alias("tokens"), _money().alias("microdollars"), each.alias("parts"), F.count_if(~part).alias("_known"),
    )
    return _with_pct(groups.filter("_known > 0").drop("_known"))


def cost_parts(costs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of window_costs: (window, owner, part): tokens, microdollars and pct over all groups, or those of each group of `keys`; parts that cost nothing only within their group."""
    rows = costs.filter((F.col("part") != WHOLE) & F.col("rate").isNotNull())
    rows = rows if keys else rows.filter("rate > 0")
    return _with_pct(rows.groupBy("window", "owner", *(keys or []), "part").agg(F.sum("tokens").alias("tokens"), _money().alias("microdollars")))


def unpriced(costs: DataFrame) -> DataFrame:
    """Of window_costs: (window, owner, provider, model, speed, reason): the tokens that have no price, most first."""
    rows = costs.filter((F.col("part") != WHOLE) & F.col("rate").isNull())
    return rows.groupBy("window", "owner", "provider", "model", "speed", "reason").agg(F.sum("tokens").alias("tokens")).orderBy("window", F.desc("tokens"), "owner", "provider", "model", "speed")


def totals_of(accounts: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sums over all accounts."""
    return accounts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def data_since(turns: DataFrame) -> DataFrame:
    return turns.agg(F.min("ts").alias("since"))


def breached_accounts(breaches: DataFrame, accounts: DataFrame) -> DataFrame:
    """(provider, account, thresholds): the names of breached thresholds of accounts that are neither suspended nor stale (status, stale)."""
    alive = accounts.filter((F.col("status") != "suspended") & ~F.col("stale")).select("provider", "account")
    return breaches.filter("breached").join(alive, ["provider", "account"], "left_semi").groupBy("provider", "account").agg(F.array_sort(F.collect_list("name")).alias("thresholds"))


def severity(value: Column, limit: Column) -> Column:
    """crit at the limit, warn from three quarters of it, else ok; null without a value or a limit."""
    return F.when(value.isNull() | limit.isNull(), None).when(value >= limit, "crit").when(value >= limit * 0.75, "warn").otherwise("ok")


def freshness(now: int, generated_at: Column, sync_ok: Column, checked_at: Column, stale_s: int = 1800) -> Column:
    """fresh, or which side has stopped: the loop that checks, the sync that fails, or the sender that has nothing newer."""
    old = lambda x: x.isNull() | (F.lit(now) - x > stale_s * 1000)
    return F.when(~old(generated_at), "fresh").when(old(checked_at), "checker stopped").when(~F.coalesce(sync_ok, F.lit(False)), "sync fails").otherwise("sender stopped")


def grants(credits: Column, kinds: list[str]) -> Column:
    """Of reset grants (array<struct<clears, remaining, total, expires_at>>): array<struct<kind, remaining, total, expires>>; kind: the first of kinds that a grant clears."""
    kind = lambda g: F.coalesce(*(F.when(F.array_contains(g["clears"], k), F.lit(k)) for k in kinds), F.lit("other"))
    expires = lambda g: F.date_format(F.timestamp_millis(g["expires_at"]) + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm")
    return F.transform(credits, lambda g: F.struct(kind(g).alias("kind"), g["remaining"].alias("remaining"), g["total"].alias("total"), expires(g).alias("expires")))
