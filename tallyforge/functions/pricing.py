"""Rate card pricing. An unknown price is never zero: such tokens are counted as unpriced, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a turn and the rate that each is priced by; writes of unknown lifetime are priced as an hour's.
RATE_OF = {"in": "in", "out": "out", "cr": "cr", "cw": "cw", "cw5m": "cw5m", "cw1h": "cw1h", "cw_unknown": "cw1h"}
#: Fixed value: dollars of a credit.
USD_PER_CREDIT = 10
#: A rate card of so many rows or fewer is sent to all tasks; a longer one is joined by Spark's own choice.
SENT_ROWS = 100_000
#: The part of a row that stands for all of its tokens, see `priced`.
WHOLE = "whole"


def sent(card: DataFrame) -> DataFrame:
    return F.broadcast(card) if card.limit(SENT_ROWS + 1).count() <= SENT_ROWS else card


def components(split_ttl: Column, whole: bool = False) -> Column:
    """array<struct<part, rate_key, tokens>> of a row with i, o, cr, cw, cw1h and cwu; without lifetimes, cache writes are one part."""
    plain = {"in": F.col("i"), "out": F.col("o"), "cr": F.col("cr"), "cw": F.col("cw")}
    split = {"in": F.col("i"), "out": F.col("o"), "cr": F.col("cr"), "cw5m": F.greatest(F.lit(0), F.col("cw") - F.col("cw1h") - F.col("cwu")), "cw1h": F.col("cw1h"), "cw_unknown": F.col("cwu")}

    def row(part: str, key: Column, tokens: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), key.alias("rate_key"), tokens.cast("bigint").alias("tokens"))

    def rows(parts: dict[str, Column]) -> Column:
        return F.array(*(row(p, F.lit(RATE_OF[p]), t) for p, t in parts.items()))

    out = F.filter(F.when(split_ttl, rows(split)).otherwise(rows(plain)), lambda x: x["tokens"] > 0)
    return F.concat(F.array(row(WHOLE, F.lit(""), F.expr("i + o + cr + cw"))), out) if whole else out


def overlaid(card: DataFrame, changes: DataFrame) -> DataFrame:
    """The card (model, rate_key, usd) with the rates of changes in place of its own; a null rate takes one away, and its model stays known."""
    new = changes.select("model", "rate_key", F.col("usd").alias("_usd"), F.lit(True).alias("_set"))
    both = card.join(new, ["model", "rate_key"], "full")
    return both.select("model", "rate_key", F.when(F.col("_set"), F.col("_usd")).otherwise(F.col("usd")).alias("usd"))


def priced(groups: DataFrame, card: DataFrame, speeds: DataFrame, long_context: DataFrame, split_ttl: Column, whole: bool = False) -> DataFrame:
    """groups with part, tokens, rate (dollars a million tokens, null if unknown) and reason, one row per part with tokens.

    card: (model, rate_key, usd; a null usd makes a model known only); a dated model name-YYYYMMDD is looked up by its name if it
    has no rates of its own. speeds: (model, speed, multiplier); standard needs no row. long_context: (model, rate_key, lc_multiplier),
    for rows with lc = 1. All three are joined without moving groups while they are short, see SENT_ROWS. whole: one more row for each
    group, of the part WHOLE, with all of its tokens, the rate 0 and the reason, if any, why none of its parts has a rate.
    """
    names = sent(card.select("model").distinct().select(F.col("model").alias("_card")))
    rows = groups.withColumn("_short", F.regexp_replace("model", r"-\d{8}$", ""))
    rows = rows.join(names.withColumnRenamed("_card", "_exact"), F.col("model") == F.col("_exact"), "left").join(names.withColumnRenamed("_card", "_by_name"), F.col("_short") == F.col("_by_name"), "left")
    rows = rows.withColumn("_card", F.coalesce("_exact", "_by_name"))
    rows = rows.join(sent(speeds.select(F.col("model").alias("_card"), F.col("speed"), F.col("multiplier").cast("decimal(8,4)"))), ["_card", "speed"], "left")
    has_long = sent(long_context.select(F.col("model").alias("_card")).distinct().withColumn("_has_long", F.lit(True)))
    rows = rows.join(has_long, "_card", "left")
    rows = rows.withColumn("_c", F.explode(components(split_ttl, whole))).select("*", "_c.part", "_c.rate_key", "_c.tokens")
    rows = rows.join(sent(card.select(F.col("model").alias("_card"), "rate_key", F.col("usd").cast("decimal(12,4)"))), ["_card", "rate_key"], "left")
    rows = rows.join(sent(long_context.select(F.col("model").alias("_card"), "rate_key", F.col("lc_multiplier").cast("decimal(8,4)"))), ["_card", "rate_key"], "left")
    reason = (
        F.when(F.col("_card").isNull(), "unknown model")
        .when((F.col("speed") != "standard") & F.col("multiplier").isNull(), "unknown speed")
        .when((F.col("lc") == 1) & F.col("_has_long").isNull(), "no long-context rate")
        .when(F.col("usd").isNull() & (F.col("part") != WHOLE), "no rate of this part")
    )
    one = F.lit(1).cast("decimal(8,4)")
    rate = F.col("usd") * F.coalesce("multiplier", one) * F.when(F.col("lc") == 1, F.coalesce("lc_multiplier", one)).otherwise(one)
    rate = F.when(F.col("part") == WHOLE, F.lit(0).cast("decimal(18,6)")).when(reason.isNull(), rate).cast("decimal(18,6)")
    return rows.withColumn("reason", reason).withColumn("rate", rate).select(*groups.columns, "part", "tokens", "rate", "reason")


def priced_sums() -> dict[str, Column]:
    """Of priced rows: microdollars (decimal, exact: tokens times dollars a million) and the tokens without a price."""
    dollars = F.sum(F.col("tokens").cast("decimal(20,0)") * F.col("rate"))
    return {
        "microdollars": F.coalesce(dollars, F.lit(0)).cast("decimal(38,6)"),
        "unpriced": F.coalesce(F.sum(F.when(F.col("rate").isNull(), F.col("tokens"))), F.lit(0)).cast("bigint"),
    }


def credits(microdollars: Column, usd_per_credit: int = USD_PER_CREDIT) -> Column:
    """Credits, to four places, of an exact sum of microdollars."""
    return F.round(microdollars.cast("decimal(38,6)") / F.lit(1_000_000 * usd_per_credit), 4).cast("decimal(38,4)")
