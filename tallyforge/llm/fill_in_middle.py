"""Fill-in-the-middle by escaped marker injection: a delimiter is put after every unit, and parts are taken by its rank.

Of a text, the delimiter's own occurrences are escaped first, so that after regexp_replace has put one behind each unit
they count the units and substring_index finds the cuts; what lies between is unescaped again. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Set behind each unit, and the character that its own occurrences are escaped with: neither is white space.
DELIMITER, ESCAPE = "\x1f", "\x1e"
#: Fixed value: what a unit is. The possessive quantifiers match the same, and never go back over a long run.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    """text without DELIMITER: ESCAPE becomes ESCAPE 0, and DELIMITER becomes ESCAPE 1."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    """The text of an escaped part with its delimiters left out."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def digest_number(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits, counted from 0, as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, spm or psm), prefix, middle, suffix, output.

    Cuts and form come from the SHA-256 of `seed:doc_id`, so they stay the same from run to run and on any machine:
    `share` in a hundred texts are taken apart, and of these `spm_share` in a hundred get their suffix first. Texts that
    are empty or hold one of the marks stay plain: their parts are null and the output is the text. A null text is
    empty, and a null id counts as an empty one. Rows with one id, repeated rows too, get the same numbers and a row
    each; an empty table gives none; a document of one unit, however long, has an empty part; further columns are not
    read, whatever their names. No shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), digest.alias("_digest"))
    marked = base.withColumn("_marked", F.regexp_replace(escaped(F.col("_text")), UNIT, "$0" + DELIMITER))
    bare = F.replace(F.col("_marked"), F.lit(DELIMITER), F.lit(""))
    counted = marked.withColumn("n", (F.char_length("_marked") - F.char_length(bare)).cast("long"))

    first, second = (F.pmod(digest_number(F.col("_digest"), k), F.col("n") + 1) for k in (0, 1))
    held = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    plain = (F.col("n") == 0) | held | (digest_number(F.col("_digest"), 2) % 100 >= share)
    form = F.when(plain, "plain").when(digest_number(F.col("_digest"), 3) % 100 < spm_share, "spm").otherwise("psm")
    ranked = counted.select("doc_id", "_text", "_marked", "n", form.alias("form"), F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b"))

    # The text ends with the delimiter of the last unit: the suffix is behind the (n - b + 1)-th from the right.
    ranked_part = lambda of, rank: F.call_function("substring_index", of, F.lit(DELIMITER), rank.cast("int"))
    a, b, whole = F.col("_a"), F.col("_b"), F.col("_marked")
    parts = {"prefix": ranked_part(whole, a), "middle": ranked_part(ranked_part(whole, b), a - b), "suffix": ranked_part(whole, b - F.col("n") - 1)}
    apart = ranked.select("doc_id", "_text", "n", "form", *(F.when(F.col("form") != "plain", unescaped(p)).alias(name) for name, p in parts.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return apart.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone. A part never holds a mark."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
