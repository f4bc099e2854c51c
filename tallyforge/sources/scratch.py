"""Tables that a step writes in the folder that all executors share, and reads back: they cut the lineage and survive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, by spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster has none to share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        where = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: The paths of the tables that were stored and not dropped yet, with the session that can drop them, and the names that some of them have.
_made: dict[str, SparkSession] = {}
_names: dict[str, str] = {}


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df, written once as a table in the shared folder and read back.

    It cuts the lineage, so that a lost executor costs no more than one step, and keeps what is read several times
    from being computed several times. The table stays until `drop_stored`, or until the program ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tallyforge-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Like `stored`, in as many buckets of a column as a shuffle has partitions: grouping and joining by it then shuffle the other side only."""
    spark = df.sparkSession
    key = uuid.uuid4().hex
    path, name = f"{scratch_dir(spark)}/tallyforge-{key}", f"spark_catalog.default.tallyforge_{key}"
    _made[path], _names[path] = spark, name
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    return spark.table(name)


def tables_stored() -> list[str]:
    """The stored tables that are there, the latest last."""
    return list(_made)


@atexit.register
def drop_stored(keep: list[str] = ()) -> None:
    """Delete the stored tables but those of keep: what was made of them must have been written by then."""
    for path in [p for p in _made if p not in keep]:
        spark = _made.pop(path)
        name = _names.pop(path, None)
        if spark.sparkContext._jsc is not None:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
