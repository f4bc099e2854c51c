"""Turns as a stream: batch files in, each turn once, alerts with a cooldown in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import COOLDOWN
from ..operators.ingest import Senders, identified, not_replayed, proven


def deduplicated(batches: DataFrame, retain: str = "30 days", senders: Senders | None = None, seed_until: int | None = None) -> DataFrame:
    """The turns of stream_batches that count, by content: each once as long as it is retained, whatever id its copies have; later copies count anew."""
    senders = senders or Senders()
    marked = batches.withColumn("_kept", not_replayed(F.col("usage"), senders))
    each = marked.select("file_path", "node", F.posexplode(F.arrays_zip("usage", "_kept")).alias("pos", "z")).filter("z._kept")
    turns = proven(identified(each.select("file_path", "node", "pos", "z.usage.*"), senders), seed_until).withColumn("event_time", F.timestamp_millis("ts"))
    return turns.withWatermark("event_time", retain).dropDuplicatesWithinWatermark(["uuid"])


def write_turns(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has come, as Parquet by day, then stop; the next call goes on from the checkpoint."""
    by_day = turns.withColumn("day", F.to_date("event_time"))
    return by_day.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()


#: Minutes that the time of the last alert is kept, no fewer than any cooldown; alerts may come so much late.
KEPT_MINUTES, LATE = 7 * 1440, "1 hour"


def cooled(alerts: DataFrame, kept_minutes: int = KEPT_MINUTES, late: str = LATE) -> DataFrame:
    """Alerts of a stream (name, account, ts, cooldown_minutes) that are sent, with the time of the last one sent as state.

    The state of a name and account goes when all alerts to come are later than it by `kept_minutes`, beyond any cooldown: it changes nothing then.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(chunks)).sort_values("ts")
        keep = []
        for ts, minutes in zip(rows["ts"], rows["cooldown_minutes"], strict=True):
            sent = last is None or ts - last >= (minutes or COOLDOWN) * 60_000
            last = ts if sent else last
            keep.append(sent)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) + kept_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep].drop(columns="_at")

    # Rows at the first watermark, which is 1970, would be late: a millisecond later none is.
    timed = alerts.withColumn("_at", F.timestamp_millis(F.col("ts") + 1)).withWatermark("_at", late)
    return timed.groupBy("name", "account").applyInPandasWithState(run, alerts.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def sent_alerts(breaches: DataFrame, accounts: DataFrame) -> DataFrame:
    """The alerts of a stream of breaches (name, provider, account, ts, cooldown_minutes, breached) that are sent: none of accounts that are suspended
    or stale by the table accounts (provider, account, status, stale), and none within the cooldown."""
    alive = accounts.filter((F.col("status") != "suspended") & ~F.col("stale")).select("provider", "account")
    return cooled(breaches.filter("breached").drop("breached").join(alive, ["provider", "account"]).select("name", "account", "ts", "cooldown_minutes"))
