"""Exact deduplication by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when they are equal without the characters [\\x20\\x09-\\x0D].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_BITS, bit_rows, bit_set, frequent, look_up, stored

#: Characters of the normalised text in the second key.
PREFIX = 64
#: Bits of the filter that carries the surviving groups into the second scan, for each of them; at least one row of 4 KB.
BITS_EACH = 16
#: Bits of a filter that is sent to all tasks (64 MB); a larger one is joined.
SENT_BITS = 1 << 29


def normalised(text: Column) -> Column:
    """text without [\\x20\\x09-\\x0D]; a null text counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the one with the most code points in the original text stays, then the one with the smallest id (a
    null id comes last); rows equal even in that count as copies of which one stays. text_sha256 is null for
    documents that the first two keys show to be alone, unless hash_all is set. An empty table gives an empty result;
    other columns are not read. row_col: a column that numbers the rows; it is added to
    the result.

    Step 1 scans for length and prefix hash and counts groups. Step 2 scans again and hashes whole texts only where the
    (length, prefix hash) group has two rows or more. The groups that survive step 1 reach step 2 as a filter of
    BITS_EACH bits for each; a false positive costs one hash. Texts are shuffled only where the filter is too large to be sent.
    """
    norm = normalised(F.col("_text"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"))
    group = [F.char_length(norm).alias("norm_len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix_hash")]

    # Groups by length and, within those of two rows or more, by prefix hash: a pair of both that is there twice is so by its length as well.
    twice = stored(base.select(*group).groupBy("norm_len", "prefix_hash").count().filter("count > 1"))
    bits = max(ROW_BITS, 1 << (BITS_EACH * twice.count()).bit_length())
    bit = F.pmod(F.xxhash64("norm_len", "prefix_hash"), F.lit(bits)) + 1
    survivors = stored(bit_rows(twice, bit))

    keyed = base.select("doc_id", "_text", "_row", F.coalesce(F.char_length("_text"), F.lit(0)).alias("n_points"), *group)
    keyed = keyed.withColumn("_bit", bit)
    sent = F.broadcast(survivors) if bits <= SENT_BITS else survivors
    keyed = keyed.withColumn("bit_row", F.bitmap_bucket_number("_bit")).join(sent, "bit_row", "left")
    alive = bit_set(F.col("bits"), F.col("_bit"))
    full = norm if hash_all else F.when(alive, norm)
    narrow = stored(
        keyed.select(
            "doc_id",
            "n_points",
            alive.alias("_alive"),
            F.sha2(full, 256).alias("text_sha256"),
            "_row",
        )
    )

    # The third key. Most code points first, then the smallest id, nulls last, then one row of several.
    rank = F.struct((-F.col("n_points")).alias("_n"), F.col("doc_id").isNull().alias("_null"), "doc_id", "_row")
    alike = narrow.filter("_alive").select("text_sha256", rank.alias("_rank"))
    groups = stored(
        alike.groupBy("text_sha256")
        .agg(F.min("_rank").alias("_best"), F.count("*").alias("group_size"))
        .select("text_sha256", "group_size", F.col("_best.doc_id").alias("keep_id"), F.col("_best._row").alias("_keep"))
        .filter("group_size > 1")
    )
    joined = look_up(narrow, groups, "text_sha256", frequent(narrow, "text_sha256", narrow.count()))
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep"))).alias("kept"),
        "text_sha256",
        *([F.col("_row").alias(row_col)] if row_col else []),
    )
