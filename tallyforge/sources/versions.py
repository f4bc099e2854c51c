"""Tables in parts that a run changes together: each part has versions, and one file of a commit says which of them count.

A table is <root>/<table>/version=<run>/part=<value>; a commit is <root>/commits/run=<n>, one file of rows (table, part, rows). A part's latest
committed version counts, and a part that a commit leaves without rows is gone. A run that breaks off before its commit has changed nothing that
is read, and writes the same versions when it is done again; a run that is committed is not done again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

_COMMIT = "table string, part string, rows long, run long"
_HIDDEN = ("version", "part")


@dataclass(frozen=True)
class Update:
    """Rows that come to a table, each with its `part`, and what old and new rows of a changed part become; None: the new rows are added."""

    rows: DataFrame
    merge: Callable[[DataFrame], DataFrame] | None = None


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, root: str) -> DataFrame:
    if not _there(spark, f"{root}/commits"):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).parquet(f"{root}/commits")


def is_committed(spark: SparkSession, root: str, run: int) -> bool:
    return not commits(spark, root).filter(F.col("run") == run).isEmpty()


def last_run(spark: SparkSession, root: str) -> int:
    """The number of the last committed run, 0 before the first."""
    return commits(spark, root).agg(F.max("run")).first()[0] or 0


def heads(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(part, version): what counts of a table. A version that only added rows goes with those before it."""
    own = commits(spark, root).filter(F.col("table") == table)
    latest = own.groupBy("part").agg(F.max("run").alias("version"), F.max_by("rows", "run").alias("rows"))
    return latest.filter("rows > 0").select("part", "version")


def current(spark: SparkSession, root: str, table: str, schema: str, parts: DataFrame | None = None, added: bool = False) -> DataFrame:
    """The rows of a table that count, with their part; of some parts only, if given. added: all committed versions, not the latest only.

    The versions that count are joined by the folders' names, so that Spark reads no other folder.
    """
    if not _there(spark, f"{root}/{table}"):
        return spark.createDataFrame([], f"{schema}, part string")
    if added:
        live = commits(spark, root).filter((F.col("table") == table) & (F.col("rows") > 0)).select("part", F.col("run").alias("version"))
    else:
        live = heads(spark, root, table)
    live = live.join(parts.select("part").distinct(), "part", "left_semi") if parts is not None else live
    rows = spark.read.schema(f"{schema}, version long, part string").option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    return rows.join(live, list(_HIDDEN), "left_semi").drop("version")


def advance(spark: SparkSession, root: str, run: int, schemas: dict[str, str], updates: dict[str, Update]) -> bool:
    """Do one run over all of its tables and commit them together; False if it was committed before.

    Only changed parts are read and written. The names of a run's parts, such as days and buckets, are bounded by the caller.
    """
    if is_committed(spark, root, run):
        return False
    said = None
    for table, update in updates.items():
        new = stored(update.rows.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("none"))))
        parts = new.select("part").distinct()
        out = new
        if update.merge:
            old = current(spark, root, table, schemas[table], parts)
            out = update.merge(old.unionByName(new.select(*old.columns)))
        path = f"{root}/{table}/version={run}"
        out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        written = spark.read.schema(f"{schemas[table]}, part string").parquet(path).groupBy("part").agg(F.count("*").alias("rows"))
        left = parts.join(written, "part", "left").select(F.lit(table).alias("table"), "part", F.coalesce("rows", F.lit(0)).alias("rows"))
        said = left if said is None else said.unionByName(left)
    commit(said, root, run)
    return True


def commit(said: DataFrame, root: str, run: int) -> None:
    """One small file, which is there as a whole or not at all."""
    mark = said.sparkSession.createDataFrame([("", "", 0)], "table string, part string, rows long")
    said.unionByName(mark).coalesce(1).withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{root}/commits")


def superseded(spark: SparkSession, root: str, table: str, before: int) -> DataFrame:
    """(part, version) of a table that no reader who started at run `before` or later can want: there is a later version up to that run."""
    own = commits(spark, root).filter((F.col("table") == table) & (F.col("run") <= before))
    last = own.groupBy("part").agg(F.max("run").alias("_last"))
    return own.join(last, "part").filter("run < _last").select("part", F.col("run").alias("version"))
