"""Ledger queries over events, each with its DuckDB SQL. AS_OF and the rate card are the queries' parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import midnight, session_scoped_id, token_measures
from ..functions.pricing import priced
from ..operators.alerts import breaches
from ..operators.attribution import first_match, tracked
from ..operators.ledger import one_per_key, session_totals, without_bursts
from ..operators.report import UNASSIGNED, bucket_matrix, by_status, days_between, drill_down, histories, history, missing_model, overlapping, unassigned_share, violations, with_shares, zero_filled
from ..operators.rollup import arbitrated, complete_from, day_cube, imported_days, refreshed, retained, with_session_cwd
from ..operators.windows import limits_of, live, rolling, shares_of_limits
from ..sources.events import TURNS_SQL, event_turns, table
from ..sources.publish import encoded

#: 2024-01-30 12:00 UTC, a time within the events.
AS_OF = 1_706_616_000_000
LONG_CONTEXT = 20_000
RULES = [(0, "ana", "/work/p0/*", None, None), (1, "ben", None, "node1", "beta"), (2, "cy", "/work/p?/c*", None, None), (3, "dee", None, "node2", None), (4, "nobody", None, None, None)]
CARD = [("purchase", k, v) for k, v in {"in": 3, "out": 15, "cr": 1, "cw": 4, "cw5m": 4, "cw1h": 6}.items()] + [("click", k, v) for k, v in {"in": 1, "out": 5, "cr": 1, "cw5m": 2, "cw1h": 2}.items()] + [("view", k, v) for k, v in {"in": 2, "out": 8, "cr": 1}.items()]
SPEEDS = [("purchase", "fast", 2), ("click", "fast", 3)]
LONG = [("purchase", "in", 2), ("purchase", "out", 2)]
THRESHOLDS = [("all", "long", None, "*", 40_000, True), ("beta only", "short", "beta", "*", 20_000, True), ("one", "long", None, "user3@example.test", 1, True), ("off", "short", None, "*", 1, False)]


#: The days of the reports, as a reader may give them.
FIRST_DAY, LAST_DAY = "2024-01-05", "2024-01-25"


def turns(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    return event_turns(table(spark, sf_dir, "events"), since, until)


def cube(spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The day cube; of the turns of the given days only, if any."""
    since, until = first and midnight(first), last and midnight(last) + 86_400_000
    return day_cube(turns(spark, sf_dir, since, until), LONG_CONTEXT, F.col("provider") == "beta")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_idx int, owner string, cwd_glob string, host string, provider string")


def rate_card(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(CARD, "model string, rate_key string, usd int"),
        spark.createDataFrame(SPEEDS, "model string, speed string, multiplier int"),
        spark.createDataFrame(LONG, "model string, rate_key string, lc_multiplier int"),
    )



def _values(rows: list[tuple], alias: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else f"'{x}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") {alias}"


OWNER = "CASE WHEN regexp_matches(cwd, '^/work/p0/') THEN 'ana' WHEN host = 'node1' AND provider = 'beta' THEN 'ben' WHEN regexp_matches(cwd, '^/work/p./c') THEN 'cy' WHEN host = 'node2' THEN 'dee' END"
CUBE_SQL = f"""WITH {TURNS_SQL}, cube AS (
  SELECT strftime(make_timestamp(ts * 1000 + 32400000000), '%Y-%m-%d') AS day, provider, account, host, session_id, cwd, model, coalesce(speed, 'standard') AS speed, coalesce(effort, '') AS effort,
    CASE WHEN provider = 'beta' AND i + cr + cw > {LONG_CONTEXT} THEN 1 ELSE 0 END AS lc, count(*) AS n, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o,
    CAST(sum(cw) AS BIGINT) AS cw, CAST(sum(cr) AS BIGINT) AS cr, CAST(sum(coalesce(cw1h, 0)) AS BIGINT) AS cw1h, CAST(sum(CASE WHEN cw1h IS NULL THEN cw ELSE 0 END) AS BIGINT) AS cwu
  FROM turns GROUP BY ALL), owned AS (SELECT *, coalesce({OWNER}, '<unassigned>') AS owner FROM cube)"""
PRICED_SQL = f"""{CUBE_SQL}, parts AS (
  SELECT o.*, p.part, p.rate_key, p.tokens FROM owned o, LATERAL (
    SELECT 'in' AS part, 'in' AS rate_key, o.i AS tokens UNION ALL SELECT 'out', 'out', o.o UNION ALL SELECT 'cr', 'cr', o.cr
    UNION ALL SELECT 'cw', 'cw', CASE WHEN o.provider = 'beta' THEN o.cw ELSE 0 END
    UNION ALL SELECT 'cw5m', 'cw5m', CASE WHEN o.provider = 'beta' THEN 0 ELSE greatest(0, o.cw - o.cw1h - o.cwu) END
    UNION ALL SELECT 'cw1h', 'cw1h', CASE WHEN o.provider = 'beta' THEN 0 ELSE o.cw1h END
    UNION ALL SELECT 'cw_unknown', 'cw1h', CASE WHEN o.provider = 'beta' THEN 0 ELSE o.cwu END) p WHERE p.tokens > 0),
priced AS (
  SELECT parts.*, CASE WHEN parts.model NOT IN (SELECT m FROM {_values(CARD, "q(m, k, u)")}) THEN 'unknown model'
      WHEN parts.speed <> 'standard' AND s.mult IS NULL THEN 'unknown speed'
      WHEN parts.lc = 1 AND parts.model NOT IN (SELECT m FROM {_values(LONG, "q(m, k, u)")}) THEN 'no long-context rate'
      WHEN c.usd IS NULL THEN 'no rate of this part' END AS reason,
    c.usd * coalesce(s.mult, 1) * CASE WHEN parts.lc = 1 THEN coalesce(l.mult, 1) ELSE 1 END AS usd_rate
  FROM parts LEFT JOIN {_values(CARD, "c(m, k, usd)")} ON c.m = parts.model AND c.k = parts.rate_key
    LEFT JOIN {_values(SPEEDS, "s(m, sp, mult)")} ON s.m = parts.model AND s.sp = parts.speed
    LEFT JOIN {_values(LONG, "l(m, k, mult)")} ON l.m = parts.model AND l.k = parts.rate_key)"""
DOLLARS = "CAST(coalesce(sum(CASE WHEN reason IS NULL THEN tokens * usd_rate END), 0) AS BIGINT) AS microdollars, CAST(coalesce(sum(CASE WHEN reason IS NOT NULL THEN tokens END), 0) AS BIGINT) AS unpriced"


def owned_cube(spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None) -> DataFrame:
    return first_match(cube(spark, sf_dir, first, last), rules(spark)).withColumn("owner", F.coalesce("owner", F.lit(UNASSIGNED)))


def report(spark: SparkSession, sf_dir: str, by: list[str], unit: str | None = None) -> DataFrame:
    """The report of the cube's days from FIRST_DAY to LAST_DAY."""
    own = owned_cube(spark, sf_dir, FIRST_DAY, LAST_DAY)
    out = history(own, by, *rate_card(spark), F.col("provider") != "beta", LAST_DAY, FIRST_DAY, unit)
    return out.withColumn("microdollars", F.col("microdollars").cast("bigint"))


_WITHIN = f"WHERE day BETWEEN '{FIRST_DAY}' AND '{LAST_DAY}'"
_BUCKETS = {None: "", "day": "day", "week": "strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d')", "month": "strftime(date_trunc('month', CAST(day AS DATE)), '%Y-%m-%d')"}


def report_sql(by: list[str], unit: str | None = None) -> str:
    """The report as the relation `r`."""
    keys = ", ".join(["1 AS _one", *by, *([f"{_BUCKETS[unit]} AS bucket"] if unit else [])])
    names = [*by, *(["bucket"] if unit else [])]
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("i", "o", "cw", "cr"))
    return f"""{PRICED_SQL}, u AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS turns, CAST(sum(i + o + cw + cr) AS BIGINT) AS tokens, {sums}, count(DISTINCT day) AS days FROM owned {_WITHIN} GROUP BY ALL),
m AS (SELECT {keys}, {DOLLARS} FROM priced {_WITHIN} GROUP BY ALL),
r AS (SELECT {"".join(f"u.{k}, " for k in names)}turns, tokens, i, o, cw, cr, days, coalesce(microdollars, 0) AS microdollars, coalesce(unpriced, 0) AS unpriced
  FROM u LEFT JOIN m ON u._one = m._one {"".join(f" AND u.{k} = m.{k}" for k in names)})"""


def _history(by: list[str], unit: str | None = None):
    return lambda spark, sf_dir: report(spark, sf_dir, by, unit), f"{report_sql(by, unit)} SELECT * FROM r"


GROUPINGS = {"owner": ["owner"], "model": ["model"], "owner_model": ["owner", "model"], "account": ["provider", "account"], "total": []}


def history_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groupings of the report by week, in one pass over the cube."""
    own = owned_cube(spark, sf_dir, FIRST_DAY, LAST_DAY)
    out = histories(own, GROUPINGS, *rate_card(spark), F.col("provider") != "beta", LAST_DAY, FIRST_DAY, "week")
    return out.withColumn("microdollars", F.col("microdollars").cast("bigint"))


def groupings_sql(groupings: dict[str, list[str]], unit: str) -> str:
    keys = list(dict.fromkeys(k for by in groupings.values() for k in by))
    sets = ", ".join(f"({', '.join([*by, 'bucket'])})" for by in groupings.values())
    name = "CASE " + " ".join(f"WHEN {' AND '.join(f'grouping({k}) = {int(k not in by)}' for k in keys)} THEN '{n}'" for n, by in groupings.items()) + " END AS grouping"
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("i", "o", "cw", "cr"))
    same = " AND ".join(f"u.{k} IS NOT DISTINCT FROM m.{k}" for k in ["grouping", *keys, "bucket"])
    return f"""{PRICED_SQL}, ob AS (SELECT *, {_BUCKETS[unit]} AS bucket FROM owned {_WITHIN}), pb AS (SELECT *, {_BUCKETS[unit]} AS bucket FROM priced {_WITHIN}),
u AS (SELECT {name}, {", ".join(keys)}, bucket, CAST(sum(n) AS BIGINT) AS turns, CAST(sum(i + o + cw + cr) AS BIGINT) AS tokens, {sums}, count(DISTINCT day) AS days FROM ob GROUP BY GROUPING SETS ({sets})),
m AS (SELECT {name}, {", ".join(keys)}, bucket, {DOLLARS} FROM pb GROUP BY GROUPING SETS ({sets}))
SELECT u.*, coalesce(microdollars, 0) AS microdollars, coalesce(unpriced, 0) AS unpriced FROM u LEFT JOIN m ON {same}"""


def report_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with their share of all money and their money a day."""
    out = with_shares(report(spark, sf_dir, ["owner"]), report(spark, sf_dir, []), "microdollars", days_between(FIRST_DAY, LAST_DAY))
    return out.select("owner", "microdollars", "share", "a_day", (F.col("dollars") * 100).cast("bigint").alias("cents"))


REPORT_SHARES_SQL = f"""{report_sql(["owner"])} SELECT owner, microdollars, CAST(floor(microdollars * 10000.0 / sum(microdollars) OVER ()) AS BIGINT) AS share, microdollars // 21 AS a_day,
  CAST(round(microdollars / 1000000.0 * 100) AS BIGINT) AS cents FROM r"""


def stack_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by week, with the weeks in which they have nothing."""
    return bucket_matrix(report(spark, sf_dir, ["owner"], "week"), ["owner"], FIRST_DAY, LAST_DAY, "week", ["microdollars", "tokens"])


STACK_CHART_SQL = f"""{report_sql(["owner"], "week")}, w AS (SELECT strftime(x, '%Y-%m-%d') AS bucket FROM generate_series(date_trunc('week', DATE '{FIRST_DAY}'), date_trunc('week', DATE '{LAST_DAY}'), INTERVAL 7 DAY) g(x)),
g AS (SELECT owner, bucket FROM (SELECT DISTINCT owner FROM r) CROSS JOIN w)
SELECT g.owner, g.bucket, coalesce(microdollars, 0) AS microdollars, coalesce(tokens, 0) AS tokens FROM g LEFT JOIN r ON r.owner = g.owner AND r.bucket = g.bucket"""

DETAIL = ["owner", "provider", "account", "model", "speed", "effort"]


def history_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each owner's use is made of."""
    return drill_down(report(spark, sf_dir, DETAIL), ["owner"]).select(*DETAIL, "turns", "tokens", "microdollars", "unpriced", "share")


HISTORY_DETAIL_SQL = f"""{report_sql(DETAIL)} SELECT owner, provider, account, model, speed, effort, turns, tokens, microdollars, unpriced,
  coalesce(CAST(floor(microdollars * 10000.0 / nullif(sum(microdollars) OVER (PARTITION BY owner), 0)) AS BIGINT), 0) AS share FROM r WHERE tokens > 0 OR microdollars > 0"""


SEVEN = ["day", "owner", "provider", "account", "model", "speed", "effort"]


def history_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir, SEVEN).drop("days")


HISTORY_CUBE_SQL = f"{report_sql(SEVEN)} SELECT * EXCLUDE (days) FROM r"


def history_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history's rows with places in sorted lists for their keys."""
    return encoded(history_cube(spark, sf_dir), SEVEN)[0].select(*SEVEN, "turns", "microdollars")


HISTORY_ENCODED_SQL = f"{report_sql(SEVEN)} SELECT " + ", ".join(f"dense_rank() OVER (ORDER BY {d}) - 1 AS {d}" for d in SEVEN) + ", turns, microdollars FROM r"


def unassigned_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unassigned_share(report(spark, sf_dir, ["owner"]))


UNASSIGNED_SQL = f"""{report_sql(["owner"])} SELECT CAST(sum(microdollars) AS BIGINT) AS microdollars, CAST(coalesce(sum(microdollars) FILTER (owner = '<unassigned>'), 0) AS BIGINT) AS unassigned FROM r"""


def missing_model_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as turns whose sender named no model."""
    return missing_model(cube(spark, sf_dir).withColumn("model", F.when(F.col("model") != "click", F.col("model"))))


MISSING_MODEL_SQL = f"{CUBE_SQL} SELECT min(day) AS first_day, max(day) AS last_day, CAST(sum(i + o + cw + cr) AS BIGINT) AS tokens FROM cube WHERE model = 'click'"


def policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast use is judged: of high effort it breaks one rule, of a purchase another; of low effort nothing is known."""
    rows = report(spark, sf_dir, ["owner", "model", "speed", "effort", "provider"], "day")
    broken = F.array_compact(F.array(F.when(F.col("effort") == "high", "effort"), F.when(F.col("model") == "purchase", "model")))
    status = F.when(F.col("speed") != "fast", "allowed").when(F.col("effort") == "low", "undetermined").when(F.size("rules") > 0, "violation").otherwise("allowed")
    rows = rows.withColumn("rules", broken).withColumn("status", status).withColumn("first_day", F.col("bucket")).withColumn("last_day", F.col("bucket"))
    return overlapping(rows, "2024-01-08", "2024-01-20")


POLICY_SQL = f"""{report_sql(["owner", "model", "speed", "effort", "provider"], "day")}, p AS (SELECT *, effort = 'high' AS r1, model = 'purchase' AS r2,
  CASE WHEN speed <> 'fast' THEN 'allowed' WHEN effort = 'low' THEN 'undetermined' WHEN effort = 'high' OR model = 'purchase' THEN 'violation' ELSE 'allowed' END AS status FROM r WHERE bucket BETWEEN '2024-01-08' AND '2024-01-20')"""
POLICY_STATUS_SQL = f"{POLICY_SQL} SELECT status, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(microdollars) AS BIGINT) AS microdollars FROM p GROUP BY status"


def policy_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array_join(F.transform("rules", lambda x: F.concat_ws(":", x["rule"], x["turns"].cast("string"))), ",")
    return violations(policy_rows(spark, sf_dir)).withColumn("rules", rules)


POLICY_PEOPLE_SQL = f"""{POLICY_SQL} SELECT owner, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(microdollars) AS BIGINT) AS microdollars,
  concat_ws(',', 'effort:' || CAST(sum(turns) FILTER (r1) AS BIGINT), 'model:' || CAST(sum(turns) FILTER (r2) AS BIGINT)) AS rules FROM p WHERE status = 'violation' GROUP BY owner"""


def daily_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir)


def cube_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cube(spark, sf_dir).groupBy("day").agg(F.sum("n").alias("n"), F.sum("i").alias("i"))
    both = own.withColumn("src", F.lit("local")).unionByName(own.withColumn("src", F.lit("central")).withColumn("i", F.col("i") * 2))
    return arbitrated(both, "2024-01-15")


CUBE_BY_ORIGIN_SQL = f"""{CUBE_SQL} SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(i) * CASE WHEN day < '2024-01-15' THEN 2 ELSE 1 END AS BIGINT) AS i,
  CASE WHEN day < '2024-01-15' THEN 'central' ELSE 'local' END AS src FROM cube GROUP BY day"""


def unpriced_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced(owned_cube(spark, sf_dir), *rate_card(spark), F.col("provider") != "beta").filter("reason is not null")
    return rows.groupBy("provider", "model", "speed", "reason").agg(F.sum("tokens").alias("tokens"))


UNPRICED_SQL = f"{PRICED_SQL} SELECT provider, model, speed, reason, CAST(sum(tokens) AS BIGINT) AS tokens FROM priced WHERE reason IS NOT NULL GROUP BY ALL"


def money_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner and part, with its share of the owner's money in 1/100 percent; parts that cost nothing are left out."""
    rows = priced(owned_cube(spark, sf_dir), *rate_card(spark), F.col("provider") != "beta").filter("rate > 0")
    each = rows.groupBy("owner", "part").agg(F.sum(F.col("tokens") * F.col("rate")).cast("bigint").alias("microdollars"))
    total = each.groupBy("owner").agg(F.sum("microdollars").alias("_all"))
    return each.join(total, "owner").select("owner", "part", "microdollars", F.expr("microdollars * 10000 div _all").alias("share"))


MONEY_BY_PART_SQL = f"""{PRICED_SQL}, e AS (SELECT owner, part, CAST(sum(tokens * usd_rate) AS BIGINT) AS microdollars FROM priced WHERE reason IS NULL AND usd_rate > 0 GROUP BY ALL)
SELECT owner, part, microdollars, microdollars * 10000 // CAST(sum(microdollars) OVER (PARTITION BY owner) AS BIGINT) AS share FROM e"""


def zero_filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each model and host on each day, of which some have none."""
    own = cube(spark, sf_dir).groupBy("model", "host", "day").agg(F.sum("n").alias("turns"), F.sum("i").alias("i"))
    return zero_filled(own, "2023-12-28", "2024-02-03", ["turns", "i"], ["model", "host"])


ZERO_FILLED_SQL = f"""{CUBE_SQL}, d AS (SELECT model, host, day, CAST(sum(n) AS BIGINT) AS turns, CAST(sum(i) AS BIGINT) AS i FROM cube GROUP BY ALL),
g AS (SELECT model, host, strftime(x, '%Y-%m-%d') AS day FROM (SELECT DISTINCT model, host FROM d) CROSS JOIN generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY) g(x))
SELECT g.model, g.host, g.day, coalesce(turns, 0) AS turns, coalesce(i, 0) AS i FROM g LEFT JOIN d ON d.model = g.model AND d.host = g.host AND d.day = g.day"""


def cube_of_session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube with each session's last path in place of its turns' own."""
    t = turns(spark, sf_dir)
    own = day_cube(with_session_cwd(t, session_totals(t)), LONG_CONTEXT, F.col("provider") == "beta")
    return own.groupBy("provider", "cwd").agg(F.sum("n").alias("n"), F.sum("i").alias("i"))


SESSION_PATHS_SQL = f"""WITH {TURNS_SQL}, st AS (SELECT provider, session_id, arg_max(cwd, (ts, uuid)) AS c FROM turns GROUP BY ALL)
SELECT t.provider, st.c AS cwd, count(*) AS n, CAST(sum(i) AS BIGINT) AS i FROM turns t JOIN st USING (provider, session_id) GROUP BY ALL"""


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's rows as another store's records, each twice: of equal keys the later counts. Joined with our own days from the cut on."""
    own = cube(spark, sf_dir)
    records = own.withColumn("pos", F.lit(0)).unionByName(own.withColumn("pos", F.lit(1)).withColumn("i", F.col("i") * 3))
    days = imported_days(records, "2024-01-15", ["pos"]).withColumn("src", F.lit("central")).unionByName(own.withColumn("src", F.lit("local")))
    return arbitrated(days, "2024-01-15").groupBy("day", "src").agg(F.sum("n").alias("n"), F.sum("i").alias("i"))


IMPORTED_SQL = f"""{CUBE_SQL} SELECT day, CASE WHEN day < '2024-01-15' THEN 'central' ELSE 'local' END AS src, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(i) * CASE WHEN day < '2024-01-15' THEN 3 ELSE 1 END AS BIGINT) AS i FROM cube GROUP BY day"""


def refreshed_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube after its turns of the first days were pruned and all others were corrected: those days stay, later ones are summed up again."""
    first = complete_from(AS_OF, 15, None)
    kept = retained(turns(spark, sf_dir), AS_OF, 15).withColumn("i", F.col("i") * 2)
    out = refreshed(cube(spark, sf_dir), day_cube(kept, LONG_CONTEXT, F.col("provider") == "beta"), first)
    return out.groupBy("day").agg(F.sum("n").alias("n"), F.sum("i").alias("i"), F.max(F.col("day") >= first).alias("again"))


REFRESHED_SQL = f"{CUBE_SQL} SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(i) * CASE WHEN day >= '2024-01-16' THEN 2 ELSE 1 END AS BIGINT) AS i, day >= '2024-01-16' AS again FROM cube GROUP BY day"


def owner_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_match(turns(spark, sf_dir).select("uuid", "cwd", "host", "provider"), rules(spark)).select("uuid", "owner")


WINDOWS = {"short": 5, "long": 168}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("provider", "account").distinct()


def account_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = token_measures(*(F.col(c) for c in ("i", "o", "cw", "cr")))
    since = AS_OF - 100 * 3_600_000
    return rolling(turns(spark, sf_dir, since), ["provider", "account"], AS_OF, WINDOWS, {k: measures[k] for k in ("total", "billable")}, since, accounts(spark, sf_dir))


ACCOUNT_WINDOWS_SQL = f"""WITH {TURNS_SQL} SELECT provider, account, """ + ", ".join(
    f"""CAST(coalesce(sum(i + o + cw + cr) FILTER (ts >= {AS_OF} - {h} * 3600000), 0) AS BIGINT) AS total_{w}, CAST(coalesce(sum(i + o + cw) FILTER (ts >= {AS_OF} - {h} * 3600000), 0) AS BIGINT) AS billable_{w},
  count(*) FILTER (ts >= {AS_OF} - {h} * 3600000) AS turns_{w}"""
    for w, h in (("short", 5), ("long", 100))
) + " FROM turns GROUP BY ALL"


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with turns in the longest window."""
    return rolling(turns(spark, sf_dir, AS_OF - 168 * 3_600_000), ["provider", "account", "session_id"], AS_OF, WINDOWS, {"total": F.expr("i + o + cw + cr")})


SESSION_WINDOWS_SQL = f"""WITH {TURNS_SQL} SELECT provider, account, session_id, CAST(sum(i + o + cw + cr) AS BIGINT) AS total_long, count(*) AS turns_long,
  CAST(coalesce(sum(i + o + cw + cr) FILTER (ts >= {AS_OF} - 5 * 3600000), 0) AS BIGINT) AS total_short, count(*) FILTER (ts >= {AS_OF} - 5 * 3600000) AS turns_short
  FROM turns WHERE ts >= {AS_OF} - 168 * 3600000 GROUP BY ALL"""


def session_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions' parts of their accounts' limits in both windows: by account and window, and none for the short one of half of the accounts."""
    number = F.regexp_extract("account", r"(\d+)", 1).cast("int")
    limit = lambda x: F.struct(x.cast("double").alias("utilization"), F.lit("soon").alias("resets_at"))
    known = accounts(spark, sf_dir).select("provider", F.col("account").alias("email"), F.create_map(F.lit("long"), limit(1000 * (number + 1)), F.lit("short"), limit(F.when(number % 2 == 0, 8000))).alias("rate_limits"))
    out = shares_of_limits(session_windows(spark, sf_dir), list(WINDOWS), limits_of(known))
    return out.withColumn("share", F.floor("share"))


SESSION_SHARE_SQL = f"""WITH {TURNS_SQL}, s AS (SELECT provider, account, session_id, CAST(coalesce(sum(i + o + cw + cr), 0) AS BIGINT) AS long, CAST(coalesce(sum(i + o + cw + cr) FILTER (ts >= {AS_OF} - 5 * 3600000), 0) AS BIGINT) AS short FROM turns WHERE ts >= {AS_OF} - 168 * 3600000 GROUP BY ALL),
e AS (SELECT provider, account, session_id, 'long' AS "window", long AS total FROM s UNION ALL SELECT provider, account, session_id, 'short', short FROM s),
a AS (SELECT *, nullif(sum(total) OVER (PARTITION BY provider, account, "window"), 0) AS t, CAST(regexp_extract(account, '(\\d+)', 1) AS INT) AS n FROM e)
SELECT provider, account, session_id, "window", total, CAST(floor(CAST(CASE WHEN "window" = 'long' THEN 1000 * (n + 1) WHEN n % 2 = 0 THEN 8000 END AS DOUBLE) * total / t) AS BIGINT) AS share FROM a"""


def pivoted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("part", F.when(F.col("ts") >= AS_OF - 168 * 3_600_000, "long").otherwise("before"))
    return t.groupBy("account").pivot("part", ["long", "before"]).agg(F.sum("i")).na.fill(0)


PIVOTED_SQL = f"WITH {TURNS_SQL} SELECT account, CAST(coalesce(sum(i) FILTER (ts >= {AS_OF} - 604800000), 0) AS BIGINT) AS long, CAST(coalesce(sum(i) FILTER (ts < {AS_OF} - 604800000), 0) AS BIGINT) AS before FROM turns GROUP BY account"


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn twice, as two deliveries: the second later, with another sender's id."""
    t = turns(spark, sf_dir).withColumn("key", session_scoped_id("beta", F.col("session_id"), F.col("model"), F.col("i"), F.col("o"), F.col("cr")))
    return t.withColumn("delivery", F.lit(2)).unionByName(t.withColumn("delivery", F.lit(1)).withColumn("ts", F.col("ts") + 500))


def first_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(doubled(spark, sf_dir).select("key", "uuid", "ts", "delivery"), "key", [F.col("delivery"), F.col("uuid")])


def earliest_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(doubled(spark, sf_dir).select("key", "uuid", "ts", "delivery"), "key", [F.col("ts"), F.col("uuid")])


def _copies_sql(order: str) -> str:
    return f"""WITH {TURNS_SQL}, k AS (SELECT 'beta:' || sha1(session_id || '|' || model || '|' || i || '|' || o || '|' || cr) AS key, uuid, ts FROM turns),
d AS (SELECT *, 2 AS delivery FROM k UNION ALL SELECT key, uuid, ts + 500, 1 FROM k)
SELECT key, uuid, ts, delivery FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS r FROM d) WHERE r = 1"""


def burst_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of fifty turns; three of a session and second in a batch are a burst. The times of every fifth turn are cut to the day, as a replay gives many the same one."""
    t = turns(spark, sf_dir).withColumn("n", F.substring("uuid", 2, 20).cast("bigint")).withColumn("batch", F.expr("n div 50"))
    t = t.withColumn("ts", F.when(F.col("n") % 5 == 0, F.expr("ts div 86400000 * 86400000")).otherwise(F.col("ts"))).withColumn("session_id", F.substring("session_id", -10, 10))
    return without_bursts(t, 3, F.col("provider") == "beta", ["batch", "session_id"]).select("uuid", "session_id", "provider")


BURST_SQL = f"""WITH {TURNS_SQL}, n AS (SELECT uuid, right(session_id, 10) AS session_id, provider, CAST(substr(uuid, 2) AS BIGINT) AS n, ts FROM turns),
b AS (SELECT *, count(*) FILTER (provider = 'beta') OVER (PARTITION BY n // 50, session_id, CASE WHEN n % 5 = 0 THEN ts // 86400000 * 86400 ELSE ts // 1000 END) AS c FROM n)
SELECT uuid, session_id, provider FROM b WHERE NOT (provider = 'beta' AND c >= 3)"""


def totals_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_totals(turns(spark, sf_dir)).withColumn("models", F.array_join("models", ","))


SESSION_TOTALS_SQL = f"""WITH {TURNS_SQL} SELECT provider, session_id, count(*) AS turns, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(cw) AS BIGINT) AS cw, CAST(sum(cr) AS BIGINT) AS cr,
  min(ts) AS first_ts, max(ts) AS last_ts, arg_max(account, (ts, uuid)) AS account, arg_max(host, (ts, uuid)) AS host, arg_max(cwd, (ts, uuid)) AS cwd, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM turns GROUP BY provider, session_id"""


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = turns(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("updated"), F.max(F.expr("i % 3")).alias("m"))
    alive = F.when(F.col("m") == 1, 1).when(F.col("m") == 0, 0)
    ok = live(AS_OF, F.col("updated"), F.lit(AS_OF - 60_000), alive, alive_s=400_000, unknown_s=100_000)
    return s.select("session_id", ok.alias("live"))


LIVE_SQL = f"""WITH {TURNS_SQL}, s AS (SELECT session_id, max(ts) AS u, max(i % 3) AS m FROM turns GROUP BY session_id)
SELECT session_id, CASE m WHEN 1 THEN {AS_OF} - u <= 400000000 WHEN 0 THEN false ELSE {AS_OF} - u <= 100000000 END AS live FROM s"""


def tracked_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = turns(spark, sf_dir).select("provider", "account").distinct()
    return a.filter(tracked(F.col("provider"), F.col("account"), ["user1@example.test", "user2@example.test", "user3@example.test"], ["beta:user2@example.test"]))


TRACKED_SQL = f"WITH {TURNS_SQL} SELECT DISTINCT provider, account FROM turns WHERE account IN ('user1@example.test', 'user2@example.test', 'user3@example.test') AND provider || ':' || account <> 'beta:user2@example.test'"


def threshold_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rolling(turns(spark, sf_dir, AS_OF - 168 * 3_600_000), ["provider", "account"], AS_OF, WINDOWS, {"v": F.col("i")}, among=accounts(spark, sf_dir))
    values = w.select("provider", "account", F.explode(F.map_from_arrays(F.array(F.lit("short"), F.lit("long")), F.array("v_short", "v_long"))).alias("window", "value"))
    return breaches(values, spark.createDataFrame(THRESHOLDS, "name string, window string, provider string, account string, limit_value long, alert boolean"))


BREACHES_SQL = f"""WITH {TURNS_SQL}, v AS (SELECT provider, account, w.window, CAST(coalesce(sum(i) FILTER (ts >= {AS_OF} - w.hours * 3600000), 0) AS BIGINT) AS value FROM turns, (VALUES ('short', 5), ('long', 168)) w("window", hours) GROUP BY ALL)
SELECT t.name, v.provider, v.account, v.window, v.value, CAST(t.limit_value AS BIGINT) AS limit_value, t.alert AND v.value >= t.limit_value AS breached
FROM v JOIN {_values(THRESHOLDS, 't(name, "window", provider, account, limit_value, alert)')} ON v.window = t.window AND (t.provider IS NULL OR t.provider = v.provider) AND (t.account = '*' OR t.account = v.account)"""

_BY = {"grand_total": ([], None), "history_by_owner": (["owner"], None), "history_by_model": (["model"], None), "history_by_owner_model": (["owner", "model"], None), "history_by_account": (["provider", "account"], None), "history_week_buckets": (["owner"], "week"), "history_month_buckets": (["model"], "month")}
_HISTORY = {name: _history(*x) for name, x in _BY.items()}

QUERIES = {name: x[0] for name, x in _HISTORY.items()} | {
    "daily_cube": daily_cube, "daily_cube_origin_split": cube_by_origin, "credit_unpriced": unpriced_by_reason, "credit_components": money_by_part, "zero_filled_days": zero_filled_days,
    "owner_first_match": owner_first_match, "rolling_windows_account": account_windows, "session_share": session_share, "pivot_windows": pivoted_windows, "dedupe_first_arrival": first_arrival,
    "dedupe_earliest": earliest_copy, "burst_filter": burst_filter, "session_totals": totals_of_sessions, "live_sessions": live_sessions, "tracked_accounts": tracked_accounts, "threshold_breach": threshold_breaches,
    "report_shares": report_shares, "stack_chart": stack_chart, "history_detail": history_detail, "history_cube": history_cube, "history_encoded": history_encoded, "unassigned_money": unassigned_money, "missing_model_note": missing_model_note, "policy_status": lambda spark, sf_dir: by_status(policy_rows(spark, sf_dir)),
    "policy_people": policy_people, "history_groupings": history_groupings, "daily_cube_session_paths": cube_of_session_paths, "imported_days": imported, "refreshed_cube": refreshed_cube, "rolling_windows_session": session_windows,
}
SQL = {name: x[1] for name, x in _HISTORY.items()} | {
    "daily_cube": f"{CUBE_SQL} SELECT * FROM cube", "daily_cube_origin_split": CUBE_BY_ORIGIN_SQL, "credit_unpriced": UNPRICED_SQL, "credit_components": MONEY_BY_PART_SQL, "zero_filled_days": ZERO_FILLED_SQL,
    "owner_first_match": f"WITH {TURNS_SQL} SELECT uuid, {OWNER} AS owner FROM turns", "rolling_windows_account": ACCOUNT_WINDOWS_SQL, "session_share": SESSION_SHARE_SQL, "pivot_windows": PIVOTED_SQL,
    "dedupe_first_arrival": _copies_sql("delivery, uuid"), "dedupe_earliest": _copies_sql("ts, uuid"), "burst_filter": BURST_SQL, "session_totals": SESSION_TOTALS_SQL, "live_sessions": LIVE_SQL, "tracked_accounts": TRACKED_SQL, "threshold_breach": BREACHES_SQL,
    "report_shares": REPORT_SHARES_SQL, "stack_chart": STACK_CHART_SQL, "history_detail": HISTORY_DETAIL_SQL, "history_cube": HISTORY_CUBE_SQL, "history_encoded": HISTORY_ENCODED_SQL, "unassigned_money": UNASSIGNED_SQL, "missing_model_note": MISSING_MODEL_SQL, "policy_status": POLICY_STATUS_SQL,
    "policy_people": POLICY_PEOPLE_SQL, "history_groupings": groupings_sql(GROUPINGS, "week"), "daily_cube_session_paths": SESSION_PATHS_SQL, "imported_days": IMPORTED_SQL, "refreshed_cube": REFRESHED_SQL, "rolling_windows_session": SESSION_WINDOWS_SQL,
}
