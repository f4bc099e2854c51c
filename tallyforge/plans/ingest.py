"""Queries on ingest, seeding and balances over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import millis_of, number, surface, token_measures
from ..operators import folds, ingest
from ..operators.ledger import session_totals
from ..operators.rollup import KEYS, MEASURES
from ..sources import inbox
from ..sources.events import TURNS_SQL, table
from ..sources.scratch import scratch_dir, stored
from ..sources.versions import advance, current
from ..streaming import cube as kept
from .board import ANCHOR, OBS, balances
from .ledger import AS_OF, CUBE_SQL, LONG_CONTEXT, turns

SENDERS = ingest.Senders(burst=3)
#: 2024-01-03, up to which a seed has counted.
SEED_UNTIL = 1_704_240_000_000


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as usage records in batches of fifty, sent twice: the second time with another sender's id. Some are assumed, some have no account or id."""
    t = turns(spark, sf_dir).withColumn("n", F.substring("uuid", 2, 20).cast("bigint"))
    n = F.col("n")
    one = t.select(
        F.concat(F.lit("b"), F.expr("n div 50").cast("string")).alias("file_path"), n.cast("int").alias("pos"), F.when(n % 31 != 0, F.col("uuid")).alias("uuid"),
        F.when(n % 5 == 0, F.expr("ts div 86400000 * 86400000")).otherwise(F.col("ts")).alias("ts"), F.when(F.col("provider") == "beta", "beta").when(n % 2 == 0, "").alias("provider"),
        F.when(n % 13 != 0, F.col("account")).alias("account_email"), F.substring("session_id", -10, 10).alias("session_id"), "model", F.when(n % 3 == 0, "other:My-CLI_2").otherwise("web").alias("surface"), "cwd",
        F.lit(None).cast("string").alias("project"), (n % 17 == 0).alias("assumed"), F.when(n % 7 == 0, F.concat(F.col("i").cast("string"), F.lit(".9"))).otherwise(F.col("i").cast("string")).alias("input_tokens"), F.col("o").cast("string").alias("output_tokens"),
        F.when(n % 11 == 0, "none").otherwise(F.col("cw").cast("string")).alias("cache_creation_tokens"), F.when(n % 4 != 0, F.col("cr").cast("string")).alias("cache_read_tokens"),
        F.when(n % 3 == 0, F.col("cw1h").cast("string")).alias("cache_creation_1h_tokens"), F.when(n % 3 == 1, "50").alias("cache_creation_5m_tokens"), "speed", "effort", F.col("host").alias("node"),
    )
    again = one.withColumn("file_path", F.concat(F.lit("c"), "file_path")).withColumn("uuid", F.concat(F.lit("x"), "uuid"))
    return one.unionByName(again)


USAGE = f"""{TURNS_SQL}, n AS (SELECT *, CAST(substr(uuid, 2) AS BIGINT) AS n FROM turns),
one AS (SELECT 'b' || n // 50 AS file_path, n AS pos, CASE WHEN n % 31 <> 0 THEN uuid END AS uuid, CASE WHEN n % 5 = 0 THEN ts // 86400000 * 86400000 ELSE ts END AS ts, CASE WHEN provider = 'beta' THEN 'beta' ELSE 'alpha' END AS provider,
  CASE WHEN n % 13 <> 0 THEN account END AS account, host, right(session_id, 10) AS session_id, cwd, model, CASE WHEN n % 3 = 0 THEN 'terminal' ELSE 'web' END AS surface, n % 17 = 0 AS assumed, i, o,
  CASE WHEN n % 11 = 0 THEN 0 ELSE cw END AS cw, CASE WHEN n % 4 <> 0 THEN cr ELSE 0 END AS cr, CASE WHEN n % 3 = 0 THEN cw1h END AS h1, CASE WHEN n % 3 = 1 THEN 50 END AS m5, speed, effort FROM n),
sent AS (SELECT * FROM one UNION ALL SELECT 'c' || file_path, pos, 'x' || uuid, * EXCLUDE (file_path, pos, uuid) FROM one),
marked AS (SELECT *, count(*) FILTER (provider = 'beta') OVER (PARTITION BY file_path, session_id, ts // 1000) AS burst FROM sent),
keyed AS (SELECT file_path, pos, CASE WHEN provider = 'beta' THEN 'beta:' || sha1(session_id || '|' || model || '|' || i || '|' || o || '|' || cr) WHEN cw <> 0 OR cr <> 0 THEN 'alpha:' || sha1(model || '|' || i || '|' || o || '|' || cw || '|' || cr) ELSE uuid END AS uuid,
  ts, provider, account, host, session_id, cwd, model, surface, i, o, cw, cr, coalesce(h1, CASE WHEN m5 IS NOT NULL THEN greatest(0, cw - m5) WHEN provider = 'beta' THEN 0 END) AS cw1h, speed, effort
  FROM marked WHERE uuid IS NOT NULL AND NOT assumed AND account IS NOT NULL AND NOT (provider = 'beta' AND burst >= 3) AND ts > {SEED_UNTIL}),
accepted AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY file_path, pos) AS r FROM keyed) WHERE r = 1)"""
TURN_COLUMNS = ["file_path", "pos", "uuid", "ts", "provider", "account", "host", "session_id", "cwd", "model", "surface", "i", "o", "cw", "cr", "cw1h", "speed", "effort"]


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accepted(raw_usage(spark, sf_dir), SENDERS, SEED_UNTIL)


def ingest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(spark, sf_dir).select(*TURN_COLUMNS).withColumn("pos", F.col("pos").cast("bigint"))


def session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_totals(accepted(spark, sf_dir), ("file_path", "pos"), ("account", "host", "cwd", "project"), ("model", "surface"))
    return s.select("provider", "session_id", "turns", "i", F.array_join("models", ",").alias("models"), F.array_join("surfaces", ",").alias("surfaces"), "cwd")


SESSION_SETS_SQL = f"""WITH {USAGE} SELECT provider, session_id, count(*) AS turns, CAST(sum(i) AS BIGINT) AS i, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces,
  arg_max(cwd, (file_path, pos)) AS cwd FROM accepted GROUP BY ALL"""


def seeded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns up to the seed's time as an older snapshot's totals, later ones on top."""
    t = turns(spark, sf_dir)
    late = t.filter(F.col("ts") > SEED_UNTIL)
    out = ingest.seeded(session_totals(late.withColumn("session_id", F.col("host"))), session_totals(t.filter(F.col("ts") <= SEED_UNTIL).withColumn("session_id", F.col("host"))))
    return out.withColumn("models", F.array_join("models", ","))


SEEDED_SQL = f"""WITH {TURNS_SQL} SELECT provider, host AS session_id, count(*) AS turns, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(cw) AS BIGINT) AS cw, CAST(sum(cr) AS BIGINT) AS cr, min(ts) AS first_ts, max(ts) AS last_ts,
  arg_max(account, (ts, uuid)) AS account, arg_max(host, (ts, uuid)) AS host, arg_max(cwd, (ts, uuid)) AS cwd, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM turns GROUP BY provider, turns.host"""


def retracted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session totals after every fifth turn was taken back."""
    t = turns(spark, sf_dir)
    return ingest.retracted(session_totals(t), t.filter(F.substring("uuid", 2, 20).cast("bigint") % 5 == 0)).select("provider", "session_id", "turns", "i", "cr")


RETRACTED_SQL = f"""WITH {TURNS_SQL} SELECT provider, session_id, count(*) FILTER (CAST(substr(uuid, 2) AS BIGINT) % 5 <> 0) AS turns, CAST(coalesce(sum(i) FILTER (CAST(substr(uuid, 2) AS BIGINT) % 5 <> 0), 0) AS BIGINT) AS i,
  CAST(coalesce(sum(cr) FILTER (CAST(substr(uuid, 2) AS BIGINT) % 5 <> 0), 0) AS BIGINT) AS cr FROM turns GROUP BY ALL"""


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are there stay, new ones come in; of several new ones the last counts."""
    t = turns(spark, sf_dir)
    new = ingest.replaced(t.select("session_id", "uuid", "ts", "i"), ["session_id"], ["ts", "uuid"])
    held = t.filter("model = 'click'").groupBy("session_id").agg(F.min("i").alias("i"))
    return ingest.inserted(held, new, ["session_id"])


UPSERTS_SQL = f"""WITH {TURNS_SQL}, h AS (SELECT session_id, min(i) AS i FROM turns WHERE model = 'click' GROUP BY session_id)
SELECT session_id, i, NULL AS uuid, NULL AS ts FROM h UNION ALL SELECT session_id, arg_max(i, (ts, uuid)), arg_max(uuid, (ts, uuid)), max(ts) FROM turns WHERE session_id NOT IN (SELECT session_id FROM h) GROUP BY session_id"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches, as JSON text read by the schema of an inbox: a node, an account with limits and credits, and a session in each, with parts left out or null."""
    k, who, ms = F.col("o_orderkey"), F.col("o_custkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    t = lambda x: x.cast("string")
    key = lambda name, value, there=F.lit(True): F.when(there, F.concat(F.lit(f'"{name}":'), value))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    resets = F.when(k % 4 == 0, obj(key("eligible", F.lit("true")), key("n", t(k % 10)))).otherwise("null")
    credits = obj(key("observed_at", t(ms)), key("balance", F.when(k % 5 == 0, "null").when(k % 5 == 1, '"none"').otherwise(t(F.round(F.col("o_totalprice") * 100).cast("bigint")))), key("limit_resets", resets, k % 4 < 2))
    account = obj(
        key("provider", F.lit('"beta"'), who % 2 == 0), key("email", quoted(F.concat(F.lit("c"), t(who)))), key("account_id", quoted(F.concat(F.lit("i"), t(k))), k % 3 == 0), key("org_name", F.lit("null")), key("rate_limit_tier", quoted(t(k % 6)), k % 2 == 0),
        key("usage_status", F.when(k % 3 == 1, "null").otherwise(quoted(t(k)))), key("usage_status_at", t(ms)), key("credits", credits, k % 7 != 0),
    )
    session = obj(
        key("session_id", quoted(F.concat(F.lit("s"), t(k % 900)))), key("cwd", quoted(F.concat(F.lit("/w/"), t(k))), k % 3 != 0), key("entrypoint", quoted(t(k % 5)), k % 4 == 0), key("surface", F.lit('"other:My-CLI_2"'), k % 5 == 0),
        key("status", F.when(k % 2 == 0, '"busy"').otherwise("null")), key("pid_alive", t(k % 2), k % 3 == 0), key("started_at", t(ms), k % 8 == 0), key("updated_at", t(ms - 1000)),
    )
    batch = obj(
        key("host", quoted(F.concat(F.lit("h"), t(k % 40)))), key("os_user", quoted(t(k % 3)), k % 3 != 0), key("fqdn", quoted(t(k))), key("machine_id", quoted(t(k % 7)), k % 4 == 1), key("diagnostics", obj(key("k", t(k))), k % 6 == 0),
        key("generated_at", t(ms)), key("accounts", F.concat(F.lit("["), account, F.lit("]"))), key("sessions", F.concat(F.lit("["), session, F.lit("]"))),
    )
    # A small file, but much work for each row, so rows are dealt over the tasks.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = orders.select(F.lpad(t(k), 12, "0").alias("file_path"), F.from_json(batch, inbox.BATCH).alias("b"))
    return text.select("b.*", "file_path", F.col("b.host").alias("node"))


_REPORTS = """r AS (SELECT o_orderkey AS k, o_custkey AS who, 'c' || o_custkey AS email, CASE WHEN o_custkey % 2 = 0 THEN 'beta' ELSE 'alpha' END AS provider, epoch_ms(o_orderdate) AS ms, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey AS pos FROM orders)"""


def folded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.folded_nodes(reports(spark, sf_dir)).select("node", "os_user", "fqdn", "home", "machine_id", "diagnostics", "last_report")


FOLDED_NODES_SQL = f"""WITH {_REPORTS} SELECT 'h' || k % 40 AS node, arg_max(CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS VARCHAR) ELSE '-' END, k) AS u, CASE WHEN u <> '-' THEN u END AS os_user, CAST(max(k) AS VARCHAR) AS fqdn, NULL AS home,
  CAST(arg_max(k % 7, k) FILTER (k % 4 = 1) AS VARCHAR) AS machine_id, '{{"k":' || max(k) FILTER (k % 6 = 0) || '}}' AS diagnostics, max(ms) AS last_report FROM r GROUP BY k % 40"""
FOLDED_NODES_SQL = f"SELECT * EXCLUDE (u) FROM ({FOLDED_NODES_SQL})"


def folded_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.folded_accounts(inbox.account_observations(reports(spark, sf_dir)), SENDERS)
    return out.select("provider", "email", "account_id", "rate_limit_tier", "org_name", "usage_status", "usage_status_at", "last_seen")


FOLDED_ACCOUNTS_SQL = f"""WITH {_REPORTS}, g AS (SELECT *, ms >= coalesce(max(ms) OVER (PARTITION BY who ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ms) AS late_enough FROM r)
SELECT provider, email, 'i' || max(k) FILTER (k % 3 = 0) AS account_id, CAST(arg_max(k % 6, k) FILTER (k % 2 = 0) AS VARCHAR) AS rate_limit_tier, NULL AS org_name, CAST(max(k) FILTER (k % 3 <> 1 AND late_enough) AS VARCHAR) AS usage_status,
  max(ms) AS usage_status_at, max(ms) AS last_seen FROM g GROUP BY provider, email"""


def folded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.folded_sessions(inbox.session_observations(reports(spark, sf_dir)), SENDERS)
    return out.select("provider", "session_id", "host", "cwd", "entrypoint", "surface", "status", "pid_alive", "started_at", "updated_at", "reported_at")


FOLDED_SESSIONS_SQL = f"""WITH {_REPORTS}, l AS (SELECT 'alpha' AS provider, 's' || k % 900 AS session_id, max(k) AS k, '/w/' || max(k) FILTER (k % 3 <> 0) AS cwd, CAST(arg_max(k % 5, k) FILTER (k % 4 = 0) AS VARCHAR) AS entrypoint,
  CASE WHEN count(*) FILTER (k % 5 = 0) > 0 THEN 'terminal' END AS surface, arg_max(ms, k) FILTER (k % 8 = 0) AS started_at, max(ms) - 1000 AS updated_at, arg_max(ms, k) AS reported_at FROM r GROUP BY k % 900)
SELECT provider, session_id, 'h' || k % 40 AS host, cwd, entrypoint, surface, CASE WHEN k % 2 = 0 THEN 'busy' END AS status, CASE WHEN k % 3 = 0 THEN k % 2 END AS pid_alive, started_at, updated_at, reported_at FROM l"""


def account_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the text of batches to the resets that an account has, its balance, and what it spent since a day."""
    observed = stored(ingest.credit_observations(inbox.account_observations(reports(spark, sf_dir)), SENDERS))
    series = stored(ingest.balance_series(observed, SENDERS))
    keys = ["provider", "email"]
    spent = folds.spent_since(series, keys, ["at"], "balance", "at", F.lit(SPENT_FROM)).select(*keys, F.col("spent").cast("bigint").alias("spent"), "since")
    now = series.groupBy(*keys).agg(F.max_by("balance", "at").cast("bigint").alias("balance"))
    return ingest.folded_credits(observed).drop("credits").join(now, keys, "left").join(spent, keys, "left")


#: 1998-04-01.
SPENT_FROM = 891_388_800_000
ACCOUNT_CREDITS_SQL = f"""WITH {_REPORTS}, c AS (SELECT * FROM r WHERE k % 7 <> 0),
g AS (SELECT *, ms >= coalesce(max(ms) OVER (PARTITION BY who ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ms) AS late_enough FROM c),
f AS (SELECT provider, email, max(ms) AS credits_at, max(k) FILTER (late_enough AND k % 4 < 2) AS told FROM g GROUP BY provider, email),
s AS (SELECT provider, email, ms, arg_min(cents, k) AS cents FROM c WHERE provider = 'beta' AND k % 5 > 1 GROUP BY ALL),
b AS (SELECT *, greatest(0, lag(cents) OVER (PARTITION BY email ORDER BY ms) - cents) AS fall FROM s),
p AS (SELECT provider, email, arg_max(cents, ms) AS balance, CAST(coalesce(sum(fall) FILTER (ms >= {SPENT_FROM}), 0) AS BIGINT) AS spent, CASE WHEN min(ms) < {SPENT_FROM} THEN {SPENT_FROM} ELSE min(ms) END AS since FROM b GROUP BY ALL)
SELECT f.provider, f.email, credits_at, CASE WHEN told % 4 = 0 THEN '{{"eligible":true,"n":' || told % 10 || '}}' END AS resets, CASE WHEN told % 4 = 0 THEN c.ms END AS resets_at, balance, spent, since
FROM f LEFT JOIN c ON c.k = f.told LEFT JOIN p ON p.email = f.email"""


def in_runs(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table after the turns came in three runs, out of order; some of the second are dated forty days too late and are taken back by the third, so
    that days become empty; the second comes again with other turns, which do not count."""
    root = f"{scratch_dir(spark)}/tallyforge-{uuid4().hex}"
    t = turns(spark, sf_dir)
    n = F.substring("uuid", 2, 20).cast("bigint")
    strays = t.filter(n % 11 == 0).withColumn("ts", F.col("ts") + 40 * 86_400_000)

    def step(run: int, own: DataFrame, more: DataFrame | None = None, gone: DataFrame | None = None) -> bool:
        rule = (LONG_CONTEXT, F.col("provider") == "beta")
        what = kept.updates(own.unionByName(more) if more is not None and table == "cube" else own, *rule, gone)
        return advance(spark, root, run, kept.SCHEMAS, {table: what[table]})

    done = [step(1, t.filter(n % 3 == 2)), step(2, t.filter(n % 3 == 0), more=strays), step(3, t.filter(n % 3 == 1), gone=strays), step(2, t.filter(n % 5 == 0))]
    if done != [True, True, True, False]:
        raise RuntimeError("a run was done twice, or not at all")
    return current(spark, root, table, kept.SCHEMAS[table])


def incremental_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_runs(spark, sf_dir, "cube").select(*KEYS, *MEASURES)


def incremental_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = in_runs(spark, sf_dir, "sessions")
    return out.select("provider", "session_id", *kept.SUMS, "first_ts", "last_ts", "last.account", "last.host", F.array_join("models", ",").alias("models"))


INCREMENTAL_SESSIONS_SQL = f"""WITH {TURNS_SQL} SELECT provider, session_id, count(*) AS turns, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(cw) AS BIGINT) AS cw, CAST(sum(cr) AS BIGINT) AS cr, min(ts) AS first_ts, max(ts) AS last_ts,
  arg_max(account, (ts, uuid)) AS account, arg_max(host, (ts, uuid)) AS host, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM turns GROUP BY provider, session_id"""


def turn_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, surfaces, times and token measures of single turns."""
    t = turns(spark, sf_dir)
    m = token_measures(F.nullif("i", F.lit(0)), F.col("o"), F.col("cw"), F.nullif("cr", F.lit(0)))
    iso = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return t.select("uuid", *(x.alias(k) for k, x in m.items()), number(F.concat(F.col("i").cast("string"), F.lit(".7"))).alias("number"), surface(F.concat(F.lit("other:x-"), "model"), {"view": "desktop", "click": "editor"}).alias("surface"), millis_of(iso).alias("ms"))


TURN_VALUES_SQL = f"""WITH {TURNS_SQL} SELECT uuid, i + o AS io, i + o + cw AS billable, i + o + cw + cr AS total, i AS number, CASE model WHEN 'view' THEN 'desktop' WHEN 'click' THEN 'editor' ELSE 'other:x-' || model END AS surface, ts AS ms FROM turns"""


def balance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as balances; one is stored where it differs by more than 50,000 from the last stored one."""
    return folds.changes(balances(spark, sf_dir).select("who", "pos", "cents"), ["who"], ["pos"], "cents", 5_000_000)


BALANCE_CHANGES_SQL = f"""WITH RECURSIVE {OBS}, b AS (SELECT who, pos, cents, row_number() OVER (PARTITION BY who ORDER BY pos) AS r FROM obs WHERE cents IS NOT NULL),
s AS (SELECT who, pos, cents, r, cents AS held, true AS kept FROM b WHERE r = 1 UNION ALL
  SELECT b.who, b.pos, b.cents, b.r, CASE WHEN abs(b.cents - s.held) > 5000000 THEN b.cents ELSE s.held END, abs(b.cents - s.held) > 5000000 FROM b JOIN s ON b.who = s.who AND b.r = s.r + 1)
SELECT who, pos, cents FROM s WHERE kept"""


def credit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balances(spark, sf_dir)
    own = b.select("who").distinct()
    return folds.credit_view(own, ["who"], b, ["seen", "pos"], "cents", "seen", F.lit(ANCHOR), F.lit(50_000_000).cast("bigint"), F.lit(7).cast("bigint"), "1998-06-15", "1998-12-31")


CREDIT_VIEW_SQL = f"""WITH {OBS}, b AS (SELECT *, greatest(0, coalesce(lag(cents) OVER (PARTITION BY who ORDER BY seen, pos), 50000000) - cents) AS fall FROM obs WHERE cents IS NOT NULL)
SELECT who, arg_max(cents, (seen, pos)) AS balance, CAST(coalesce(sum(fall) FILTER (seen >= '{ANCHOR}'), 0) AS BIGINT) AS month_spent, '{ANCHOR}' AS month_since, 50000000 - arg_max(cents, (seen, pos)) AS total_spent, 7 AS monthly_limit FROM b GROUP BY who"""


def asof_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each unknown price: the customer's last known one before it."""
    b = balances(spark, sf_dir)
    from .board import observations

    asked = observations(spark, sf_dir).filter("cents is null").select("who", "seen", "pos")
    return folds.as_of_many(asked, b.select("who", "seen", "pos", "cents"), ["who"], "cents", "seen", ["pos"])


ASOF_MANY_SQL = f"WITH {OBS}, b AS (SELECT who, seen, arg_max(cents, pos) AS cents FROM obs WHERE cents IS NOT NULL GROUP BY ALL) SELECT a.who, a.seen, a.pos, b.cents FROM obs a ASOF LEFT JOIN b ON a.who = b.who AND a.seen > b.seen WHERE a.cents IS NULL"

QUERIES = {
    "ingest_turns": ingest_turns, "session_sets": session_sets, "seeded_totals": seeded_totals, "retracted_totals": retracted_totals, "upserts": upserts, "turn_values": turn_values,
    "balance_changes": balance_changes, "credit_view": credit_view, "asof_many": asof_many, "folded_nodes": folded_nodes, "folded_accounts": folded_accounts, "folded_sessions": folded_sessions, "account_credits": account_credits, "incremental_cube": incremental_cube, "incremental_sessions": incremental_sessions,
}
SQL = {
    "ingest_turns": f"WITH {USAGE} SELECT {', '.join(TURN_COLUMNS)} FROM accepted", "session_sets": SESSION_SETS_SQL, "seeded_totals": SEEDED_SQL, "retracted_totals": RETRACTED_SQL, "upserts": UPSERTS_SQL, "turn_values": TURN_VALUES_SQL,
    "balance_changes": BALANCE_CHANGES_SQL, "credit_view": CREDIT_VIEW_SQL, "asof_many": ASOF_MANY_SQL, "folded_nodes": FOLDED_NODES_SQL, "folded_accounts": FOLDED_ACCOUNTS_SQL, "folded_sessions": FOLDED_SESSIONS_SQL, "account_credits": ACCOUNT_CREDITS_SQL, "incremental_cube": f"{CUBE_SQL} SELECT * FROM cube", "incremental_sessions": INCREMENTAL_SESSIONS_SQL,
}
