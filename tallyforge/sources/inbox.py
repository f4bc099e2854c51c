"""Batch files of nodes: one JSON object each, <inbox>/<node>/batch-*.json or .json.gz."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USAGE = """struct<uuid string, ts bigint, provider string, account_email string, session_id string, model string, surface string, cwd string,
project string, assumed boolean, input_tokens string, output_tokens string, cache_creation_tokens string, cache_read_tokens string,
cache_creation_1h_tokens string, cache_creation_5m_tokens string, speed string, effort string>"""
ACCOUNT = """struct<provider string, email string, account_id string, org_type string, rate_limit_tier string, display_name string, org_name string, rate_limits_updated_at bigint,
rate_limits map<string, struct<utilization double, resets_at string>>, usage_status string, usage_status_at bigint, credits variant>"""
SESSION = """struct<provider string, session_id string, account_email string, cwd string, project string, version string, kind string,
entrypoint string, surface string, status string, pid bigint, pid_alive int, started_at bigint, updated_at bigint>"""
BATCH = f"host string, os_user string, sender_root string, fqdn string, ip string, machine_id string, home string, diagnostics variant, generated_at bigint, accounts array<{ACCOUNT}>, sessions array<{SESSION}>, usage array<{USAGE}>, _corrupt string".replace("\n", " ")


def _options(reader, pattern: str):
    return reader.schema(BATCH).option("multiLine", True).option("pathGlobFilter", pattern).option("columnNameOfCorruptRecord", "_corrupt")


def _with_origin(raw: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    folder = F.element_at(F.split(path, "/"), -2)
    return raw.select("*", path.alias("file_path"), F.coalesce(F.nullif("host", F.lit("")), folder).alias("node"))


def read_batches(spark: SparkSession, inbox: str, ignore_hosts: list[str] | None = None, pattern: str = "batch-*.{json,json.gz}") -> DataFrame:
    """One row per batch with file_path and node (the host, else the folder). Truncated JSON has `_corrupt` and no arrays."""
    out = _with_origin(_options(spark.read, pattern).json(f"{inbox}/*"))
    return out.filter(~F.col("node").isin(*ignore_hosts)) if ignore_hosts else out


def listing(spark: SparkSession, inbox: str, ignore_hosts: list[str] | None = None, pattern: str = "batch-*.{json,json.gz}") -> DataFrame:
    """(path, size, mtime) of the batch files of an inbox, without empty ones and those of ignored hosts; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{inbox}/*")
    out = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
    return out.filter(~F.element_at(F.split("path", "/"), -2).isin(*ignore_hosts)) if ignore_hosts else out


def read_changed(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The batches of changed_files, like read_batches. A file that is no gzip or no JSON object has `_corrupt`, and fails no other.

    The paths of new files go to the driver: as many as came since the last run.
    """
    paths = [r.path for r in files.select("path").orderBy("path").collect()]
    if not paths:
        return spark.createDataFrame([], f"{BATCH}, file_path string, node string")
    raw = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file_path"), _inflated(F.col("content")).alias("_body"))
    batch = F.from_json("_body", BATCH.rsplit(", _corrupt", 1)[0], {"mode": "PERMISSIVE"})
    fine = F.coalesce(F.schema_of_variant(F.try_parse_json("_body")).startswith("OBJECT"), F.lit(False))
    out = raw.withColumn("_b", F.when(fine, batch)).withColumn("_corrupt", F.when(~fine, F.coalesce("_body", F.lit(""))))
    folder = F.element_at(F.split("file_path", "/"), -2)
    return out.select("_b.*", "_corrupt", "file_path").withColumn("node", F.coalesce(F.nullif("host", F.lit("")), folder))


@F.pandas_udf(T.StringType())
def _inflated(content: pd.Series) -> pd.Series:
    def text(x: bytes) -> str | None:
        try:
            return (gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x).decode("utf-8")
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None

    return content.map(text)


def recorded(done: DataFrame, files: DataFrame, batches: DataFrame) -> DataFrame:
    """done (path, size, mtime) after a run: with the files that were read in place of what was known of them; failed ones are tried again."""
    good = files.join(batches.filter(F.col("_corrupt").isNull()).select(F.col("file_path").alias("path")), "path", "left_semi").select("path", "size", "mtime")
    return done.join(good, "path", "left_anti").select("path", "size", "mtime").unionByName(good)


def scan_counts(listing: DataFrame, files: DataFrame, batches: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row: batches, skipped, failed, usage_rows, total_batches of a run."""
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    good, bad = batches.filter(F.col("_corrupt").isNull()), batches.filter(F.col("_corrupt").isNotNull())
    old = listing.filter("size > 0").join(files.select("path"), "path", "left_anti")
    parts = [one(good, "batches"), one(old, "skipped"), one(bad, "failed"), one(accepted, "usage_rows"), one(listing, "total_batches")]
    every = parts[0].withColumn("_k", F.lit(0))
    for p in parts[1:]:
        every = every.join(p.withColumn("_k", F.lit(0)), "_k")
    return every.drop("_k")


def stream_batches(spark: SparkSession, inbox: str, files_per_trigger: int = 50, pattern: str = "batch-*.{json,json.gz}") -> DataFrame:
    return _with_origin(_options(spark.readStream, pattern).option("maxFilesPerTrigger", files_per_trigger).json(f"{inbox}/*"))


def changed_files(listing: DataFrame, done: DataFrame) -> DataFrame:
    """The files of a listing (path, size, mtime) that are not among those done with the same size and mtime; empty ones are left out."""
    return listing.filter(F.col("size") > 0).join(done, ["path", "size", "mtime"], "left_anti")


def _each(batches: DataFrame, part: str, *columns: str) -> DataFrame:
    """columns, pos and the fields of each record of an array. An inner posexplode would have the array tested for null and for size before it, and
    each test parses a batch that is text once more; so the batches without records are taken away behind it."""
    return batches.select(*columns, F.posexplode_outer(part).alias("pos", "_x")).filter(F.col("pos").isNotNull()).select(*columns, "pos", "_x.*")


def raw_turns(batches: DataFrame) -> DataFrame:
    """(file_path, node, pos, usage fields): a row per usage record, in arrival order by (file_path, pos)."""
    return _each(batches, "usage", "file_path", "node")


def account_observations(batches: DataFrame) -> DataFrame:
    return _each(batches, "accounts", "file_path", "node", "generated_at").filter(F.col("email").isNotNull())


def session_observations(batches: DataFrame) -> DataFrame:
    return _each(batches, "sessions", "file_path", "node", "generated_at").filter(F.col("session_id").isNotNull())
