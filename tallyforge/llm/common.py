"""What the operators share: scratch tables, a skew-proof look-up join and fixed-size bit filters."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bits in one row of a filter: bitmap_construct_agg makes bitmaps of 4 KB.
ROW_BITS = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; its package is imported where it is asked for only."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A column of that name is added to documents for a while.
ROW = "_tallyforge_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs, stored, with the column ROW that tells its rows apart, equal ones too."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of `numbered` docs whose ROW is not in dropped, without that column.

    The numbers are stored first: by their size Spark sends them to the tasks, or joins by a shuffle where they are many.
    """
    return docs.join(stored(dropped.select(ROW)), ROW, "left_anti").drop(ROW)


def give_back() -> None:
    """What a task has freed goes back to the system: its worker process stays, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: Parts into which the rows of a frequent key are dealt.
SALTS = 64


def frequent(left: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """The keys with more than one in `share` of left's rows, stored: fewer than `share` rows, whatever the data."""
    often = left.groupBy(key).count().filter((F.col("count") > max(rows // share, 1)) & F.col(key).isNotNull())
    return stored(often.select(key))


def look_up(left: DataFrame, right: DataFrame, key: str, often: DataFrame) -> DataFrame:
    """left with right's columns, where right has one row at most for each key; rows without a match keep nulls.

    often: of `frequent`. Rows of left with such a key would fill one task: they are dealt into SALTS parts by a hash of
    the row, and right's rows for these keys (fewer than 1000) are repeated once for each part. A null key matches nothing; rows
    with it are dealt out as well.
    """
    mark = often.select(key, F.lit(True).alias("_often"))
    salt = F.when(F.col("_often") | F.col(key).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(0).cast("int")
    parts = F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.join(F.broadcast(mark), key, "left").withColumn("_salt", salt).drop("_often")
    each = right.join(F.broadcast(mark), key, "left").withColumn("_salt", F.explode(parts)).drop("_often")
    return salted.join(each.hint("merge"), [key, "_salt"], "left").drop("_salt")


def bit_rows(keys: DataFrame, bit: Column) -> DataFrame:
    """The set of `bit` numbers (1 or more) as rows (bit_row, bits) of 4 KB; as many as the largest number needs."""
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("bit_row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )


def bit_set(bits: Column, bit: Column) -> Column:
    """Whether a row of bit_rows has that bit; false where there is no row."""
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def bit_array(rows: DataFrame, size: int) -> np.ndarray:
    """rows of bit_rows as an array of size bits, packed: size / 8 bytes go to the driver, however many keys there are."""
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.collect():
        at = (r.bit_row - 1) * (ROW_BITS // 8)
        out[at : at + len(r.bits)] |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def has_bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number, counted from 0, whether bit_array's result has it."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
