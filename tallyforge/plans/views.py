"""Queries on accounts, sessions, people and their costs, over events, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import credits
from ..operators import alerts, views
from ..operators.attribution import owners
from ..operators.ledger import session_totals
from ..operators.order import coded
from ..operators.rollup import retained
from ..sources.events import TURNS_SQL
from .ledger import AS_OF, LONG_CONTEXT, PRICED_SQL, WINDOWS, _values, accounts, rate_card, rules, threshold_breaches, turns

HOUR = 3_600_000
PINS = [("7-2024-01-10", "pin"), ("3-2024-01-29", "pin")]
EXCLUDED = ["beta:user5@example.test", "beta:user11@example.test"]
FORCED = {"alpha:user1@example.test": "suspended", "user2@example.test": "paused", "beta:nobody@example.test": "suspended", "alpha:idle@example.test": "closed"}


def total() -> dict[str, Column]:
    return {"total": F.expr("i + o + cw + cr")}


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_totals(turns(spark, sf_dir))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nodes say of most sessions, made of their turns."""
    s, k = totals(spark, sf_dir), F.col("i") % 4
    return s.filter(k != 3).select(
        "provider", "session_id", F.lit("node9").alias("host"), F.lit(None).cast("string").alias("account"), F.when(k == 1, "/work/p0/x").alias("cwd"),
        F.when(k == 1, 1).when(k == 2, 0).alias("pid_alive"), (F.col("last_ts") + 60_000).alias("updated_at"), F.when(k == 0, "busy").alias("status"), (F.col("first_ts") - 1000).alias("started_at"),
    )


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"node{k}", AS_OF - k * 600_000) for k in range(4)], "host string, last_report long")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = spark.createDataFrame(PINS, "session_id string, owner string")
    return views.session_view(totals(spark, sf_dir), meta(spark, sf_dir), nodes(spark), AS_OF, rules(spark), pins, [], EXCLUDED, alive_s=400_000, unknown_s=100_000)


def owner_sql(cwd: str, host: str = "host", provider: str = "provider") -> str:
    return f"CASE WHEN regexp_matches({cwd}, '^/work/p0/') THEN 'ana' WHEN {host} = 'node1' AND {provider} = 'beta' THEN 'ben' WHEN regexp_matches({cwd}, '^/work/p./c') THEN 'cy' WHEN {host} = 'node2' THEN 'dee' END"


SESSIONS = f"""WITH {TURNS_SQL}, st AS (SELECT provider, session_id, count(*) AS turns, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(cw) AS BIGINT) AS cw, CAST(sum(cr) AS BIGINT) AS cr,
  min(ts) AS first_ts, max(ts) AS last_ts, arg_max(account, (ts, uuid)) AS account, arg_max(host, (ts, uuid)) AS host, arg_max(cwd, (ts, uuid)) AS cwd FROM turns GROUP BY provider, session_id),
k AS (SELECT *, i % 4 <> 3 AS told, CASE i % 4 WHEN 1 THEN '/work/p0/x' END AS launch, CASE i % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS alive, CASE WHEN i % 4 = 3 THEN last_ts ELSE last_ts + 60000 END AS updated,
  CASE WHEN i % 4 = 0 THEN 'busy' ELSE 'active' END AS status, CAST(right(host, 1) AS INT) * 600000 AS age FROM st),
sessions AS (SELECT provider, session_id, turns, i, o, cw, cr, first_ts, last_ts, account, host, cwd, updated, status, first_ts AS started_at,
  age <= 900000 AND CASE alive WHEN 1 THEN {AS_OF} - updated <= 400000000 WHEN 0 THEN false ELSE {AS_OF} - updated <= 100000000 END AS live,
  provider || ':' || account NOT IN ('beta:user5@example.test', 'beta:user11@example.test') AS tracked,
  coalesce(pin.owner, {owner_sql("cwd")}, {owner_sql("launch")}, '<unassigned>') AS owner FROM k LEFT JOIN {_values(PINS, "pin(sid, owner)")} ON pin.sid = k.session_id)"""

SESSION_COLUMNS = ["provider", "session_id", "account", "host", "cwd", "turns", "updated", "status", "started_at", "live", "tracked", "owner"]


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).filter("tracked").orderBy(*views.session_order()).select(*SESSION_COLUMNS)


def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("session_id", "account", "host", "cwd", "owner")]
    return sessions(spark, sf_dir).filter(views.found_in("USER1", *fields)).select("provider", "session_id", "owner")


def owner_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose own path no rule fits, by the path that they were launched from."""
    s = turns(spark, sf_dir).select("uuid", "session_id", F.when(F.col("ts") % 3 == 0, F.col("cwd")).alias("cwd"), F.lit(None).cast("string").alias("host"), "provider", F.col("cwd").alias("launch_cwd"))
    pins = spark.createDataFrame(PINS, "session_id string, owner string")
    return owners(s, rules(spark), pins).select("uuid", "owner")


OWNER_FALLBACK_SQL = f"""WITH {TURNS_SQL} SELECT uuid, coalesce(pin.owner, CASE WHEN ts % 3 = 0 THEN {owner_sql("cwd", "NULL")} END, {owner_sql("cwd", "NULL")}) AS owner
FROM turns LEFT JOIN {_values(PINS, "pin(sid, owner)")} ON pin.sid = session_id"""


def people_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.people(sessions(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("providers", "hosts", "accounts")})


PEOPLE_SQL = f"""{SESSIONS} SELECT owner, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(cw) AS BIGINT) AS cw, CAST(sum(cr) AS BIGINT) AS cr, count(*) FILTER (live) AS live_sessions,
  string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts FROM sessions WHERE tracked GROUP BY owner"""


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the longest window."""
    return turns(spark, sf_dir, AS_OF - max(WINDOWS.values()) * HOUR)


def person_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.person_windows(recent(spark, sf_dir), sessions(spark, sf_dir), AS_OF, WINDOWS, total())


def person_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = views.person_windows(recent(spark, sf_dir), sessions(spark, sf_dir), AS_OF, WINDOWS, total(), by_account=True)
    return views.account_pivot(both, list(WINDOWS), "total")


_WINDOW = "CAST(coalesce(sum(t.i + t.o + t.cw + t.cr) FILTER (t.ts >= {start}), 0) AS BIGINT) AS total_{w}, count(*) FILTER (t.ts >= {start}) AS turns_{w}"
_WINDOW_SUMS = ", ".join(_WINDOW.format(w=w, start=AS_OF - h * HOUR) for w, h in WINDOWS.items())
_RECENT = f"FROM turns t JOIN sessions s USING (provider, session_id) WHERE t.ts >= {AS_OF - max(WINDOWS.values()) * HOUR}"
PERSON_WINDOWS_SQL = f"{SESSIONS} SELECT s.owner, {_WINDOW_SUMS} {_RECENT} GROUP BY s.owner"
PERSON_BREAKDOWN_SQL = f"{SESSIONS}, b AS (SELECT s.owner, provider, t.account, {_WINDOW_SUMS} {_RECENT} GROUP BY ALL) SELECT owner, provider, account, total_short, total_long FROM b WHERE total_long > 0 OR total_short > 0"


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each owner's turns cost in both windows."""
    since = AS_OF - max(WINDOWS.values()) * HOUR
    return views.window_costs(turns(spark, sf_dir, since), sessions(spark, sf_dir), AS_OF, WINDOWS, LONG_CONTEXT, F.col("provider") == "beta", *rate_card(spark), F.col("provider") != "beta")


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("microdollars", F.col("microdollars").cast("bigint"))


#: The pricing of the cube's SQL over groups of the window, with the owner of each session.
_GROUPS = f"""{SESSIONS}, w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {h})" for k, h in WINDOWS.items())}) v("window", hours)), owned AS (SELECT "window", s.owner, provider, t.account, t.model, coalesce(t.speed, 'standard') AS speed, coalesce(t.effort, '') AS effort,
  CASE WHEN provider = 'beta' AND t.i + t.cr + t.cw > {LONG_CONTEXT} THEN 1 ELSE 0 END AS lc, count(*) AS n, CAST(sum(t.i) AS BIGINT) AS i, CAST(sum(t.o) AS BIGINT) AS o, CAST(sum(t.cw) AS BIGINT) AS cw, CAST(sum(t.cr) AS BIGINT) AS cr,
  CAST(sum(coalesce(t.cw1h, 0)) AS BIGINT) AS cw1h, CAST(sum(CASE WHEN t.cw1h IS NULL THEN t.cw ELSE 0 END) AS BIGINT) AS cwu FROM turns t JOIN sessions s USING (provider, session_id) JOIN w ON t.ts >= {AS_OF} - w.hours * {HOUR} GROUP BY ALL)"""
COSTS = _GROUPS + PRICED_SQL[PRICED_SQL.index(", parts AS") :]
_MONEY = "CAST(coalesce(sum(tokens * usd_rate) FILTER (reason IS NULL), 0) AS BIGINT)"
_OWNERS = f"""oc AS (SELECT "window", owner, {_MONEY} AS everything FROM priced GROUP BY ALL)"""
_PCT = "coalesce(CAST(round(microdollars * 10000.0 / nullif(everything, 0)) AS BIGINT), 0) AS pct"


def credit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with what each of their parts has and costs."""
    parts = F.array_join(F.transform("parts", lambda x: F.concat(x["part"], F.lit("="), x["tokens"].cast("string"), F.lit(":"), x["microdollars"].cast("bigint").cast("string"))), ";")
    return _whole(views.cost_groups(costs(spark, sf_dir)).withColumn("parts", parts))


CREDIT_GROUPS_SQL = f"""{COSTS}, {_OWNERS}, g AS (SELECT "window", owner, provider, account, model, speed, effort, lc, any_value(n) AS turns, CAST(coalesce(sum(tokens) FILTER (reason IS NULL), 0) AS BIGINT) AS tokens, {_MONEY} AS microdollars,
    coalesce(string_agg(part || '=' || tokens || ':' || CAST(floor(tokens * usd_rate) AS BIGINT), ';' ORDER BY part) FILTER (reason IS NULL), '') AS parts FROM priced WHERE reason IS NULL OR reason = 'no rate of this part' GROUP BY ALL)
SELECT g.*, {_PCT} FROM g JOIN oc USING ("window", owner)"""


def credit_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(views.cost_parts(costs(spark, sf_dir)))


CREDIT_PCT_SQL = f"""{COSTS}, {_OWNERS}, g AS (SELECT "window", owner, part, CAST(sum(tokens) AS BIGINT) AS tokens, {_MONEY} AS microdollars FROM priced WHERE reason IS NULL AND usd_rate > 0 GROUP BY ALL)
SELECT g.*, {_PCT} FROM g JOIN oc USING ("window", owner)"""


def credit_group_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(views.cost_parts(costs(spark, sf_dir), ["model", "speed"]))


CREDIT_GROUP_PARTS_SQL = f"""{COSTS}, {_OWNERS}, g AS (SELECT "window", owner, model, speed, part, CAST(sum(tokens) AS BIGINT) AS tokens, {_MONEY} AS microdollars FROM priced WHERE reason IS NULL GROUP BY ALL)
SELECT g.*, {_PCT} FROM g JOIN oc USING ("window", owner)"""


def owner_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.unpriced(costs(spark, sf_dir))


OWNER_UNPRICED_SQL = f"""{COSTS} SELECT "window", owner, provider, model, speed, reason, CAST(sum(tokens) AS BIGINT) AS tokens FROM priced WHERE reason IS NOT NULL GROUP BY ALL"""


def people_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits in units of 1/10000."""
    return views.owner_costs(costs(spark, sf_dir)).select("window", "owner", (credits(F.col("microdollars")) * 10_000).cast("bigint").alias("credits"))


PEOPLE_BY_COST_SQL = f"""{COSTS} SELECT "window", owner, CAST(round({_MONEY} / 1000.0) AS BIGINT) AS credits FROM priced GROUP BY ALL"""


def account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a status and the time of their last use, made of their turns, and those that never reported."""
    a = turns(spark, sf_dir).groupBy("provider", "account").agg(F.max("ts").alias("at"), F.sum("i").alias("i"))
    a = views.with_unreported(a, ["nobody@example.test", "idle@example.test", "user1@example.test"], ["alpha", "beta"], FORCED)
    reported = F.when(F.col("i") % 3 == 0, "auth_error").otherwise("ok")
    fetched = F.col("at") - F.col("i") % 5 * 1_000_000
    status = views.account_status(F.col("provider"), F.col("account"), reported, F.col("at"), fetched, FORCED)
    return a.select("provider", "account", status.alias("status"), views.stale(fetched, AS_OF).alias("stale"))


_STATE = f"""WITH {TURNS_SQL}, a AS (SELECT provider, account, max(ts) AS used, CAST(sum(i) AS BIGINT) AS i FROM turns GROUP BY ALL UNION ALL SELECT * FROM (VALUES ('alpha', 'idle@example.test', NULL, NULL), ('beta', 'nobody@example.test', NULL, NULL)) x),
state AS (SELECT provider, account, CASE WHEN provider || ':' || account IN ('alpha:user1@example.test', 'beta:nobody@example.test') THEN 'suspended' WHEN account = 'user2@example.test' THEN 'paused' WHEN account = 'idle@example.test' THEN 'closed'
  WHEN i % 3 = 0 AND i % 5 * 1000000 > 1800000 THEN 'auth_error' ELSE 'ok' END AS status, coalesce({AS_OF} - (used - i % 5 * 1000000) > 3600000, false) AS stale FROM a)"""


def account_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = views.account_view(accounts(spark, sf_dir), recent(spark, sf_dir), totals(spark, sf_dir), meta(spark, sf_dir), AS_OF, WINDOWS, total())
    return views.totals_of(view, [f"{c}_{w}" for w in WINDOWS for c in ("total", "turns")] + ["life_turns", "life_tokens"])


ACCOUNT_TOTALS_SQL = f"""WITH {TURNS_SQL} SELECT {_WINDOW_SUMS}, count(*) AS life_turns, CAST(sum(i + o + cw + cr) AS BIGINT) AS life_tokens FROM turns t"""


def account_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meta(spark, sf_dir).drop("account").join(totals(spark, sf_dir).select("provider", "session_id", "account"), ["provider", "session_id"])
    out = views.account_view(accounts(spark, sf_dir), recent(spark, sf_dir), totals(spark, sf_dir), m, AS_OF, WINDOWS, total(), count_from=AS_OF - 100 * HOUR, live_s=100_000)
    return out.select("provider", "account", "total_short", "total_long", "life_turns", "life_tokens", F.array_join("hosts", ",").alias("hosts"), F.array_join("live_hosts", ",").alias("live_hosts"))


ACCOUNT_VIEW_SQL = f"""{SESSIONS}, u AS (SELECT provider, account, CAST(coalesce(sum(i + o + cw + cr) FILTER (ts >= {AS_OF - 5 * HOUR}), 0) AS BIGINT) AS total_short, CAST(coalesce(sum(i + o + cw + cr) FILTER (ts >= {AS_OF - 100 * HOUR}), 0) AS BIGINT) AS total_long FROM turns GROUP BY ALL),
h AS (SELECT provider, account, CAST(sum(turns) AS BIGINT) AS life_turns, CAST(sum(i + o + cw + cr) AS BIGINT) AS life_tokens, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts,
  CASE WHEN max(last_ts + 60000) FILTER (i % 4 <> 3) >= {AS_OF - 100_000_000} THEN 'node9' ELSE '' END AS live_hosts FROM st GROUP BY ALL)
SELECT * FROM u JOIN h USING (provider, account)"""


def breach_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.breached_accounts(threshold_breaches(spark, sf_dir), account_state(spark, sf_dir))
    return out.withColumn("thresholds", F.array_join("thresholds", ","))


_BREACHES = f"""{_STATE}, v AS (SELECT provider, account, CAST(coalesce(sum(i) FILTER (ts >= {AS_OF - 168 * HOUR}), 0) AS BIGINT) AS long, CAST(coalesce(sum(i) FILTER (ts >= {AS_OF - 5 * HOUR}), 0) AS BIGINT) AS short FROM turns GROUP BY ALL),
b AS (SELECT 'all' AS name, provider, account, 'long' AS "window", long AS value, 40000 AS limit_value FROM v WHERE long >= 40000 UNION ALL SELECT 'beta only', provider, account, 'short', short, 20000 FROM v WHERE provider = 'beta' AND short >= 20000
  UNION ALL SELECT 'one', provider, account, 'long', long, 1 FROM v WHERE account = 'user3@example.test' AND long >= 1),
alive AS (SELECT b.* FROM b JOIN state USING (provider, account) WHERE status <> 'suspended' AND NOT stale)"""
BREACH_LIST_SQL = f"{_BREACHES} SELECT provider, account, string_agg(name, ',' ORDER BY name) AS thresholds FROM alive GROUP BY ALL"


def alerts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the accounts were alerted of ten or of fifty minutes ago."""
    log = accounts(spark, sf_dir).select((F.lit(AS_OF) - F.when(F.length("account") % 2 == 0, 600_000).otherwise(3_000_000)).alias("ts"), F.lit("all").alias("name"), "account")
    found = threshold_breaches(spark, sf_dir).withColumn("cooldown_minutes", F.lit(0))
    return alerts.to_send(found, account_state(spark, sf_dir), AS_OF, log)


ALERTS_DUE_SQL = f"""{_BREACHES} SELECT {AS_OF} AS ts, name, account, provider, "window", value, CAST(limit_value AS BIGINT) AS limit_value FROM alive WHERE NOT (name = 'all' AND length(account) % 2 = 0)"""


def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's sums of input tokens of each account as alerts, at noon, with a cooldown of fifty hours."""
    days = turns(spark, sf_dir).groupBy("account", (F.floor(F.col("ts") / 86_400_000) * 86_400_000).alias("ts")).agg(F.sum("i").alias("value"))
    return alerts.with_cooldown(days.filter("value > 9000").select(F.lit("day").alias("name"), "account", "ts", F.lit(3000).alias("cooldown_minutes")))


ALERT_COOLDOWN_SQL = f"""WITH RECURSIVE {TURNS_SQL}, d AS (SELECT account, ts // 86400000 * 86400000 AS ts FROM turns GROUP BY ALL HAVING sum(i) > 9000),
s AS (SELECT account, min(ts) AS ts FROM d GROUP BY account UNION ALL SELECT s.account, (SELECT min(d.ts) FROM d WHERE d.account = s.account AND d.ts >= s.ts + 180000000) FROM s WHERE s.ts IS NOT NULL)
SELECT 'day' AS name, account, ts, 3000 AS cooldown_minutes FROM s WHERE ts IS NOT NULL"""


def severity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_breaches(spark, sf_dir).select("name", "provider", "account", views.severity(F.col("value"), F.col("limit_value")).alias("severity"))


SEVERITY_SQL = f"""WITH {TURNS_SQL}, v AS (SELECT provider, account, CAST(coalesce(sum(i) FILTER (ts >= {AS_OF - 168 * HOUR}), 0) AS BIGINT) AS long, CAST(coalesce(sum(i) FILTER (ts >= {AS_OF - 5 * HOUR}), 0) AS BIGINT) AS short FROM turns GROUP BY ALL),
b AS (SELECT 'all' AS name, provider, account, long AS value, 40000 AS l FROM v UNION ALL SELECT 'beta only', provider, account, short, 20000 FROM v WHERE provider = 'beta' UNION ALL SELECT 'one', provider, account, long, 1 FROM v WHERE account = 'user3@example.test'
  UNION ALL SELECT 'off', provider, account, short, 1 FROM v)
SELECT name, provider, account, CASE WHEN value >= l THEN 'crit' WHEN value >= 0.75 * l THEN 'warn' ELSE 'ok' END AS severity FROM b"""


def colour_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each account, by the order of their names."""
    a = turns(spark, sf_dir).select(F.concat_ws(":", "provider", "account").alias("who")).distinct()
    return coded(a, "who", "colour")


COLOURS_SQL = f"WITH {TURNS_SQL} SELECT who, dense_rank() OVER (ORDER BY who) - 1 AS colour FROM (SELECT DISTINCT provider || ':' || account AS who FROM turns)"


def retained_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(turns(spark, sf_dir), AS_OF, 10).select("uuid")


QUERIES = {
    "session_list": session_list, "session_search": session_search, "owner_fallback": owner_fallback, "people_lifetime": people_lifetime, "person_windows": person_windows, "person_breakdown": person_breakdown,
    "credit_groups": credit_groups, "credit_pct": credit_pct, "credit_group_parts": credit_group_parts, "owner_unpriced": owner_unpriced, "people_by_cost": people_by_cost, "account_status": account_state, "account_totals": account_totals,
    "account_view": account_view, "breach_list": breach_list, "alerts_due": alerts_due, "alert_cooldown": alert_cooldown, "severity_classes": severity_classes, "colour_index": colour_index, "retained_turns": retained_turns,
    "data_since": lambda spark, sf_dir: views.data_since(turns(spark, sf_dir)),
}
SQL = {
    "session_list": f"{SESSIONS} SELECT {', '.join(SESSION_COLUMNS)} FROM sessions WHERE tracked", "session_search": f"{SESSIONS} SELECT provider, session_id, owner FROM sessions WHERE account LIKE '%user1%'", "owner_fallback": OWNER_FALLBACK_SQL,
    "people_lifetime": PEOPLE_SQL, "person_windows": PERSON_WINDOWS_SQL, "person_breakdown": PERSON_BREAKDOWN_SQL, "credit_groups": CREDIT_GROUPS_SQL, "credit_pct": CREDIT_PCT_SQL, "credit_group_parts": CREDIT_GROUP_PARTS_SQL,
    "owner_unpriced": OWNER_UNPRICED_SQL, "people_by_cost": PEOPLE_BY_COST_SQL, "account_status": f"{_STATE} SELECT * FROM state", "account_totals": ACCOUNT_TOTALS_SQL, "account_view": ACCOUNT_VIEW_SQL, "breach_list": BREACH_LIST_SQL,
    "alerts_due": ALERTS_DUE_SQL, "alert_cooldown": ALERT_COOLDOWN_SQL, "severity_classes": SEVERITY_SQL, "colour_index": COLOURS_SQL, "retained_turns": f"WITH {TURNS_SQL} SELECT uuid FROM turns WHERE ts >= {AS_OF} - 864000000",
    "data_since": f"WITH {TURNS_SQL} SELECT min(ts) AS since FROM turns",
}
