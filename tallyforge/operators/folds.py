"""Folds of observations that come late and out of order, as windows and aggregates with the arrival order as a column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .scan import AT, SEGMENT, earlier, local, previous, segmented, with_carried


def last_values(rows: DataFrame, keys: list[str], order: list[str], always: list[str], known: list[str], largest: list[str] = ()) -> DataFrame:
    """Of each key: the last value of `always`, nulls too, the last value that is known of `known`, and the largest of `largest`."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(
        *(F.max_by(F.struct(c), at)[c].alias(c) for c in always),
        *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in known),
        *(F.max(c).alias(c) for c in largest),
    )


def last_records(rows: DataFrame, keys: list[str], order: list[str], stamp: str, wanted: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(keys, a struct _stamp and _what of each name, _most): of each (ok, what), `what` of the last row that is ok and whose stamp is none
    earlier than all stamps before it, with that stamp; and the latest stamp. All are found in one walk.

    Within a segment, such rows have rising stamps. So if the last of them is behind a stamp of the segments before, all are: of each segment
    that row and the latest stamp say enough.
    """
    own = [x.alias(f"_{kind}_{name}") for name, pair in wanted.items() for kind, x in zip(("ok", "what"), pair, strict=True)]
    cut = segmented(rows.select(*keys, *order, F.col(stamp).alias("_stamp"), *own), keys, order)
    highest = F.max("_stamp").over(local(keys).rowsBetween(Window.unboundedPreceding, -1))
    held = cut.withColumn("_late", F.col("_stamp") >= F.coalesce(highest, F.col("_stamp")))
    last = lambda name: F.max_by(F.struct("_stamp", F.col(f"_what_{name}").alias("_what")), F.when(F.col(f"_ok_{name}") & F.col("_late"), F.col(AT)))
    parts = stored(held.groupBy(*keys, SEGMENT).agg(*(last(name).alias(name) for name in wanted), F.max("_stamp").alias("_most")))
    before = F.max("_most").over(earlier(keys))
    accepted = parts.select("*", *((F.col(name)["_stamp"] >= F.coalesce(before, F.col(name)["_stamp"])).alias(f"_in_{name}") for name in wanted))
    return accepted.groupBy(*keys).agg(*(F.max_by(name, F.when(F.col(f"_in_{name}"), F.col(SEGMENT))).alias(name) for name in wanted), F.max("_most").alias("_most"))


def guarded_latest(rows: DataFrame, keys: list[str], order: list[str], value: str, stamp: str) -> DataFrame:
    """(keys, value, stamp): a known value replaces the held one if its stamp is none earlier than all stamps before it.

    The stamp of a null value counts too, so this is not the value with the largest stamp.
    """
    out = last_records(rows, keys, order, stamp, {"_last": (F.col(value).isNotNull(), F.col(value))})
    return out.select(*keys, F.col("_last._what").alias(value), F.col("_most").alias(stamp))


def carried_forward(rows: DataFrame, keys: list[str], order: list[str], stamp: str, present: Column, part: str) -> DataFrame:
    """(keys, part, part_at): the part of the last accepted row that has it, an explicit null too, with that row's stamp."""
    out = last_records(rows, keys, order, stamp, {"_last": (present, F.col(part))})
    return out.select(*keys, F.col("_last._what").alias(part), F.col("_last._stamp").alias("part_at"))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str, least: float = 0) -> DataFrame:
    """The rows that are stored: first ones, and those whose value differs from that of the last stored row by more than `least`.

    Rows without a value are never stored. With a `least`, what a segment stores depends on the value held before it: each segment starts from
    a guess, the last value before it, and those whose guess was not what the segment before ends with are gone through again, until none is
    left. Two walks meet at the first jump beyond the spread of their held values, so few rounds are needed. Most keys lie in one segment and
    need no guess: only those in several, of which there are no more than ranges, are gone through before the rows are stored.
    """
    cut = segmented(rows.filter(F.col(value).isNotNull()), keys, order)
    ends = stored(cut.groupBy(*keys, SEGMENT).agg(F.max_by(value, AT).alias("_end")))
    guess = ends.select(*keys, SEGMENT, F.lag("_end").over(previous(keys)).alias("_held"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    guess = stored(guess.filter("_n > 1").drop("_n"))
    if not least:
        before = F.coalesce(F.lag(value).over(local(keys)), F.col("_held"))
        kept = with_carried(cut, keys, guess, "left").withColumn("_before", before)
        return kept.filter(F.col("_before").isNull() | (F.col(value) != F.col("_before"))).select(*rows.columns)

    names = cut.columns

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            keep = []
            for first, told, start, x in zip(*(pdf[c].tolist() for c in ("_first", "_told", "_start", value)), strict=True):
                if first:
                    held = start if told else None
                keep.append(held is None or abs(x - held) > least)
                held = x if keep[-1] else held
            yield pdf.loc[keep, names]

    def kept_of(begun: DataFrame) -> DataFrame:
        """The rows of cut that are stored, by the held value that each segment begins with; a window leaves segments whole and in order."""
        marked = begun.withColumn("_told", F.col("_held").isNotNull()).withColumn("_start", F.coalesce("_held", value)).drop("_held")
        return marked.withColumn("_first", F.lag(AT).over(local(keys)).isNull()).mapInPandas(walked, cut.schema)

    todo, known = guess, None
    while not todo.isEmpty():
        shut = kept_of(with_carried(cut, keys, todo)).groupBy(*keys, SEGMENT).agg(F.max_by(value, AT).alias("_shut"))
        lasts = with_carried(todo, keys, shut, "left").select(*keys, SEGMENT, F.coalesce("_shut", "_held").alias("_last"))
        again = todo.select(*keys, SEGMENT)
        known = stored(lasts if known is None else lasts.unionByName(known.join(again.withColumn("_again", F.lit(True)), _same(known, again, keys), "left_anti")))
        real = stored(known.select(*keys, SEGMENT, F.lag("_last").over(previous(keys)).alias("_real")))
        both = with_carried(guess, keys, real)
        todo = stored(both.filter(~F.col("_held").eqNullSafe(F.col("_real"))).select(*keys, SEGMENT, F.col("_real").alias("_held")))
        guess = stored(both.select(*keys, SEGMENT, F.col("_real").alias("_held")))
    return kept_of(with_carried(cut, keys, guess, "left")).select(*rows.columns)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = left[SEGMENT] == right[SEGMENT]
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def spent_since(rows: DataFrame, keys: list[str], order: list[str], value: str, at: str, since: Column, initial: Column | None = None) -> DataFrame:
    """(keys, spent, anchor, since): decreases of a balance since a time; rises do not count.

    They count from the anchor: the last observation before that time, else the initial value, if one is given, else the first observation;
    with the latter, `since` is its own time. A key without observations has no row. Of a segment, the falls within it, its first and its last
    observation are kept; the fall into its first one comes from the segment before.
    """
    cut = segmented(rows.withColumn("_since", since).withColumn("_initial", initial if initial is not None else F.lit(None).cast(rows.schema[value].dataType)), keys, order)
    fall = lambda before, now: F.greatest(F.lit(0), before - now)
    here = F.lag(AT).over(local(keys)).isNotNull() & (F.col(at) >= F.col("_since"))
    cut = cut.withColumn("_fall", F.when(here, fall(F.coalesce(F.lag(value).over(local(keys)), F.col("_initial")), F.col(value))))
    now = F.struct(F.col(value).alias("v"), F.col(at).alias("at"), F.col("_since").alias("since"), F.col("_initial").alias("initial"))
    parts = stored(
        cut.groupBy(*keys, SEGMENT).agg(
            F.sum("_fall").alias("_falls"), F.min_by(now, AT).alias("_first"), F.max_by(value, AT).alias("_last"),
            F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(at) < F.col("_since"), F.col(AT))).alias("_before"), F.min(at).alias("_least"),
        )
    )
    entry = fall(F.coalesce(F.lag("_last").over(previous(keys)), F.col("_first.initial")), F.col("_first.v"))
    parts = parts.withColumn("_entry", F.when(F.col("_first.at") >= F.col("_first.since"), entry))
    first, before = F.min_by("_first", SEGMENT), F.max_by("_before", F.when(F.col("_before").isNotNull(), F.col(SEGMENT)))
    start = F.coalesce(first["initial"], first["v"]) if initial is not None else first["v"]
    known = before.isNotNull() | F.lit(initial is not None)
    return parts.groupBy(*keys).agg(
        (F.coalesce(F.sum("_falls"), F.lit(0)) + F.coalesce(F.sum("_entry"), F.lit(0))).alias("spent"),
        F.coalesce(before["v"], start).alias("anchor"),
        F.when(known, first["since"]).otherwise(F.min("_least")).alias("since"),
    )


def credit_view(accounts: DataFrame, keys: list[str], balances: DataFrame, order: list[str], value: str, at: str, since: Column, initial: Column, limit: Column, today: str, limit_until: str | None) -> DataFrame:
    """accounts with balance (the latest), total_spent (initial minus balance), month_spent, month_since and monthly_limit (null after its last day)."""
    now = balances.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("balance"))
    month = spent_since(balances, keys, order, value, at, since, initial).select(*keys, F.col("spent").alias("month_spent"), F.col("since").alias("month_since"))
    out = accounts.join(now, keys, "left").join(month, keys, "left").withColumn("total_spent", initial - F.col("balance"))
    return out.withColumn("monthly_limit", limit if limit_until is None or today <= limit_until else F.lit(None).cast("bigint"))


def as_of(rows: DataFrame, keys: list[str], order: list[str], value: str, at: str, when: Column) -> DataFrame:
    return rows.filter(F.col(at) < when).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def as_of_many(times: DataFrame, rows: DataFrame, keys: list[str], value: str, at: str, order: list[str]) -> DataFrame:
    """times (keys, at, ...) with the last value of rows before each time; null where there is none.

    Both are put into one sequence of each key, an observation after the times equal to its own, and carried forward: within a segment, and
    where it has none before a time, from the segments before.
    """
    more = [c for c in times.columns if c not in [*keys, at]]
    own = [f"_o{i}" for i in range(len(order))]
    asked = times.select(*keys, at, F.lit(0).alias("_seen"), *(F.lit(None).cast(rows.schema[c].dataType).alias(o) for c, o in zip(order, own, strict=True)), F.lit(None).cast(rows.schema[value].dataType).alias(value), F.struct(*(more or [F.lit(1).alias("_none")])).alias("_more"))
    held = rows.select(*keys, at, F.lit(1).alias("_seen"), *(F.col(c).alias(o) for c, o in zip(order, own, strict=True)), value, F.lit(None).cast(asked.schema["_more"].dataType).alias("_more"))
    cut = segmented(asked.unionByName(held), keys, [at, "_seen", *own])
    ends = stored(cut.groupBy(*keys, SEGMENT).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(AT))).alias("_end")))
    carried = stored(ends.select(*keys, SEGMENT, F.last("_end", ignorenulls=True).over(earlier(keys)).alias("_carried")))
    here = F.last(value, ignorenulls=True).over(local(keys).rowsBetween(Window.unboundedPreceding, -1))
    out = with_carried(cut.withColumn("_here", here).filter("_seen = 0"), keys, carried)
    return out.select(*keys, at, *(F.col(f"_more.{c}").alias(c) for c in more), F.coalesce("_here", "_carried").alias(value))
