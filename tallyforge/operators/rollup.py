"""The day cube, which outlives the turns it was made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import local_day

KEYS = ["day", "provider", "account", "host", "session_id", "cwd", "model", "speed", "effort", "lc"]
MEASURES = ["n", "i", "o", "cw", "cr", "cw1h", "cwu"]


def measure_sums() -> list[Column]:
    """Sums of turns for a price: the parts, and the cache writes for an hour and of unknown lifetime."""
    unknown = F.when(F.col("cw1h").isNull(), F.col("cw")).otherwise(0)
    sums = {"i": F.col("i"), "o": F.col("o"), "cw": F.col("cw"), "cr": F.col("cr"), "cw1h": F.coalesce("cw1h", F.lit(0)), "cwu": unknown}
    return [F.count("*").alias("n"), *(F.sum(F.coalesce(x, F.lit(0))).cast("bigint").alias(c) for c, x in sums.items())]


def priceable(turns: DataFrame, long_context_over: int, long_context: Column) -> DataFrame:
    """turns with lc (a long context is told turn by turn) and with a speed and an effort where there are none."""
    size = F.coalesce("i", F.lit(0)) + F.coalesce("cr", F.lit(0)) + F.coalesce("cw", F.lit(0))
    out = turns.withColumn("lc", F.when(long_context & (size > long_context_over), 1).otherwise(0))
    return out.withColumn("speed", F.coalesce(F.nullif("speed", F.lit("")), F.lit("standard"))).withColumn("effort", F.coalesce("effort", F.lit("")))


def day_cube(turns: DataFrame, long_context_over: int, long_context: Column, offset_s: int = 32400) -> DataFrame:
    """KEYS and n, i, o, cw, cr, cw1h, cwu (cache writes of unknown lifetime)."""
    rows = priceable(turns, long_context_over, long_context).withColumn("day", local_day(F.col("ts"), offset_s))
    return rows.groupBy(*KEYS).agg(*measure_sums())


def with_session_cwd(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """turns with the path that their session was last seen in, empty where the session is unknown, in place of their own."""
    known = totals.select(F.col("provider").alias("_p"), F.col("session_id").alias("_s"), F.coalesce("cwd", F.lit("")).alias("_cwd"))
    joined = turns.drop("cwd").join(known, (F.col("provider") == F.col("_p")) & (F.col("session_id") == F.col("_s")), "left")
    return joined.withColumn("cwd", F.coalesce("_cwd", F.lit(""))).drop("_p", "_s", "_cwd")


def arbitrated(cube: DataFrame, cut: str | None) -> DataFrame:
    """Imported days before the cut and own days from it on; own days only without a cut."""
    own = F.col("src") == "local"
    return cube.filter(own if cut is None else (own & (F.col("day") >= cut)) | (~own & (F.col("day") < cut)))


def imported_days(records: DataFrame, cut: str, order: list[str]) -> DataFrame:
    """Day records of another store before the cut, as cube rows; of those with the same KEYS the last by `order` counts."""
    texts = [F.coalesce(c, F.lit("standard" if c == "speed" else "")).alias(c) for c in KEYS if c not in ("day", "provider", "lc")]
    rows = records.filter(F.col("day") < cut).select("day", "provider", *texts, F.coalesce("lc", F.lit(0)).cast("int").alias("lc"), *(F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES), *order)
    last = F.max_by(F.struct(*MEASURES), F.struct(*order))
    return rows.groupBy(*KEYS).agg(last.alias("_m")).select(*KEYS, "_m.*")


def complete_from(now: int, retain_days: int | None, cut: str | None, offset_s: int = 32400) -> str:
    """The first day that the retained turns still hold in full and that is not imported; earlier days of the cube stay as they are."""
    from datetime import UTC, datetime

    first = datetime.fromtimestamp((now - (retain_days - 1) * 86_400_000) / 1000 + offset_s, UTC).strftime("%Y-%m-%d") if retain_days else "0000-00-00"
    return max(first, cut or first)


def refreshed(cube: DataFrame, again: DataFrame, first: str) -> DataFrame:
    """The cube with all of its days from `first` on replaced by those of `again`; a day that has become empty goes."""
    return cube.filter(F.col("day") < first).unionByName(again.filter(F.col("day") >= first).select(*cube.columns))


def retained(turns: DataFrame, now: int, days: int | None) -> DataFrame:
    return turns.filter(F.col("ts").isNull() | (F.col("ts") >= now - days * 86_400_000)) if days else turns


def write_days(cube: DataFrame, path: str) -> None:
    """Replace the days of the cube in a table by day; days that have become empty must be dropped by the caller."""
    cube.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
