"""An events table (event_id, ts, user_id, event_type, value, props) read as turns of a usage ledger."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts) -> F.Column:
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def event_turns(events: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Turns with integer measures: i input, o output, cw cache writes (cw1h of them for an hour, null if unknown), cr cache reads.

    since, until: epoch milliseconds of the first and behind the last turn; as bounds of the table's own column they reach its scan.
    """
    at = lambda ms: F.lit((datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(sep=" ")).cast("timestamp_ntz")
    events = events.filter(F.col("ts") >= at(since)) if since is not None else events
    events = events.filter(F.col("ts") < at(until)) if until is not None else events
    k = F.get_json_object("props", "$.k").cast("bigint")
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    cw = n % 7 * 100
    return events.select(
        F.concat(F.lit("e"), n.cast("string")).alias("uuid"),
        millis(F.col("ts")).alias("ts"),
        F.when(F.col("event_type").isin("purchase", "error"), "beta").otherwise("alpha").alias("provider"),
        F.concat(F.lit("user"), user, F.lit("@example.test")).alias("account"),
        F.concat(user, F.lit("-"), F.date_format(F.col("ts"), "yyyy-MM-dd")).alias("session_id"),
        F.concat(F.lit("node"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.concat(F.lit("/work/p"), (F.col("user_id") % 5).cast("string"), F.lit("/"), F.col("event_type")).alias("cwd"),
        F.col("event_type").alias("model"),
        F.when(n % 5 == 0, "fast").when(n % 5 == 1, "standard").alias("speed"),
        F.when(n % 4 == 0, "high").when(n % 4 == 1, "low").alias("effort"),
        F.round(F.col("value") * 100).cast("bigint").alias("i"),
        k.alias("o"),
        cw.alias("cw"),
        F.when(n % 3 != 0, F.floor(cw / 2)).cast("bigint").alias("cw1h"),
        (k * 10).alias("cr"),
    )


#: The same in DuckDB SQL.
TURNS_SQL = r"""turns AS (
  SELECT 'e' || event_id AS uuid, epoch_us(ts) // 1000 AS ts, CASE WHEN event_type IN ('purchase', 'error') THEN 'beta' ELSE 'alpha' END AS provider,
    'user' || user_id || '@example.test' AS account, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, 'node' || (user_id % 4) AS host,
    '/work/p' || (user_id % 5) || '/' || event_type AS cwd, event_type AS model,
    CASE event_id % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' END AS speed, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS effort, CAST(round(value * 100) AS BIGINT) AS i,
    CAST(json_extract(props, '$.k') AS BIGINT) AS o, event_id % 7 * 100 AS cw,
    CASE WHEN event_id % 3 <> 0 THEN (event_id % 7 * 100) // 2 END AS cw1h, CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS cr
  FROM events)"""
