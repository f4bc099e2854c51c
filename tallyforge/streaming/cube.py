"""The day cube and the session totals kept up to date from batch to batch: only the days and sessions that a batch touches are summed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Senders, accepted
from ..operators.order import with_position
from ..operators.rollup import KEYS, MEASURES, day_cube
from ..sources import inbox as files
from ..sources.scratch import stored
from ..sources.versions import Update, advance, current, last_run

#: Buckets of sessions and of paths: a batch writes those that it touches.
BUCKETS = 64
SUMS = ["turns", "i", "o", "cw", "cr"]
LAST = "struct<ts:bigint,uuid:string,account:string,host:string,cwd:string>"
SCHEMAS = {
    "cube": ", ".join(f"{k} {'int' if k == 'lc' else 'string'}" for k in KEYS) + ", " + ", ".join(f"{m} long" for m in MEASURES),
    "sessions": f"provider string, session_id string, {', '.join(f'{c} long' for c in SUMS)}, first_ts long, last_ts long, last {LAST}, models array<string>",
    "turns": "uuid string, ts long",
    "files": "path string, size long, mtime long",
}


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def cube_rows(turns: DataFrame, long_context_over: int, long_context: Column, sign: int = 1) -> DataFrame:
    """The cube of a batch's turns, part by day; sign -1 for turns that are taken back."""
    own = day_cube(turns, long_context_over, long_context)
    return own.select(F.col("day").alias("part"), *KEYS, *((F.col(m) * sign).cast("long").alias(m) for m in MEASURES))


def merged_cube(rows: DataFrame) -> DataFrame:
    """Measures add up; a key without turns goes, and so does a day without keys."""
    return rows.groupBy("part", *KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).filter("n > 0")


def session_rows(turns: DataFrame) -> DataFrame:
    """The totals of a batch's turns by (provider, session), part by a hash of both; `last` is what was seen last, by time and id."""
    key = F.coalesce(F.nullif("session_id", F.lit("")), F.concat(F.lit("_"), "uuid"))
    own = turns.withColumn("session_id", key).groupBy("provider", "session_id").agg(
        F.count("*").alias("turns"), *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in SUMS[1:]), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max(F.struct("ts", "uuid", "account", "host", "cwd")).alias("last"), F.collect_set(F.nullif("model", F.lit(""))).alias("models"),
    )
    return own.withColumn("part", _bucket("provider", "session_id"))


def merged_sessions(rows: DataFrame) -> DataFrame:
    models = F.array_sort(F.array_distinct(F.flatten(F.collect_list("models"))))
    return rows.groupBy("part", "provider", "session_id").agg(*(F.sum(c).alias(c) for c in SUMS), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("last").alias("last"), models.alias("models"))


def updates(turns: DataFrame, long_context_over: int, long_context: Column, gone: DataFrame | None = None) -> dict[str, Update]:
    """What a batch of new turns, and of turns that are taken back, does to the cube; totals of sessions keep what they have counted."""
    cube = cube_rows(turns, long_context_over, long_context)
    if gone is not None:
        cube = cube.unionByName(cube_rows(gone, long_context_over, long_context, -1))
    return {"cube": Update(cube, merged_cube), "sessions": Update(session_rows(turns), merged_sessions)}


def keep_up(turns: DataFrame, root: str, checkpoint: str, long_context_over: int, long_context: Column) -> StreamingQuery:
    """A stream of deduplicated turns into the cube and the totals; a micro-batch that is done again after a crash counts once."""

    def run(batch: DataFrame, number: int) -> None:
        advance(batch.sparkSession, root, number, SCHEMAS, updates(stored(batch), long_context_over, long_context))

    return turns.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_inbox(spark: SparkSession, inbox: str, root: str, long_context_over: int, long_context: Column, senders: Senders | None = None, most: int = 10_000, ignore_hosts: list[str] | None = None) -> dict[str, int]:
    """Read what is new in an inbox into turns, cube, totals and the ledger of files, in runs of `most` files, the oldest first; returns counts.

    A file is new if the ledger does not have its path with its size and time: rewritten files are read again, broken ones are counted as failed
    and tried again by the next call. A run commits its turns, cube, totals and files together, so one that breaks off is done again as a whole.
    Of the files, `most` paths at a time go to the driver. A turn counts once, by content, over all runs.
    """
    senders = senders or Senders()
    listing = stored(files.listing(spark, inbox, ignore_hosts))
    new = files.changed_files(listing, current(spark, root, "files", SCHEMAS["files"]).select("path", "size", "mtime"))
    placed = stored(with_position(new, ["mtime", "path"]))
    total, n = listing.count(), placed.count()
    counts = {"batches": 0, "skipped": listing.filter("size > 0").count() - n, "failed": 0, "usage_rows": 0, "total_batches": total}
    for k in range(0, n, most):
        chosen = stored(placed.filter((F.col("position") >= k) & (F.col("position") < k + most)).drop("position"))
        batches = stored(files.read_changed(spark, chosen))
        before = current(spark, root, "turns", SCHEMAS["turns"], added=True)
        turns = stored(accepted(files.raw_turns(batches.filter(F.col("_corrupt").isNull())), senders, before=before))
        good = files.recorded(spark.createDataFrame([], SCHEMAS["files"]), chosen, batches).withColumn("part", _bucket("path"))
        more = {"turns": Update(turns.select("uuid", "ts", F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("part"))), "files": Update(good, latest_files)}
        advance(spark, root, last_run(spark, root) + 1, SCHEMAS, updates(turns, long_context_over, long_context) | more)
        failed = batches.filter(F.col("_corrupt").isNotNull()).count()
        counts |= {"batches": counts["batches"] + batches.count() - failed, "failed": counts["failed"] + failed, "usage_rows": counts["usage_rows"] + turns.count()}
    return counts


def latest_files(rows: DataFrame) -> DataFrame:
    """Of each path, the size and time with which it was read last."""
    return rows.groupBy("part", "path").agg(F.max_by(F.struct("size", "mtime"), "mtime").alias("_f")).select("part", "path", "_f.size", "_f.mtime")
