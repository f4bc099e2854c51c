"""The history report: group, bucket, price and rank the day cube."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import WHOLE, credits, priced, priced_sums

UNASSIGNED = "<unassigned>"


def bucket(day: Column, unit: str) -> Column:
    """yyyy-MM-dd of the day, its Monday or the first of its month."""
    d = F.to_date(day)
    return F.date_format({"day": d, "week": F.trunc(d, "week"), "month": F.trunc(d, "month")}[unit], "yyyy-MM-dd")


def month_end(day: Column) -> Column:
    return F.date_format(F.last_day(F.to_date(day)), "yyyy-MM-dd")


def presets(first: str, last: str) -> dict[str, tuple[str, str]]:
    """Named ranges of days up to the last one, none before the first: 7 and 30 days, this month, the month before (if it has data), all."""
    end = date.fromisoformat(last)
    this_month = end.replace(day=1)
    month_before = (this_month - timedelta(days=1)).replace(day=1)
    clip = lambda d: max(first, d.isoformat())
    out = {"7 days": (clip(end - timedelta(days=6)), last), "30 days": (clip(end - timedelta(days=29)), last), "this month": (clip(this_month), last)}
    if month_before.isoformat()[:7] >= first[:7]:
        out["last month"] = (clip(month_before), (this_month - timedelta(days=1)).isoformat())
    return out | {"all": (first, last)}


def within(cube: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Rows of the days between two, whichever way round they come."""
    return cube.filter(F.col("day").between(*sorted((first, last)))) if first and last else cube


def _priced_grain(cube: DataFrame, keys: list[str], card: DataFrame, speeds: DataFrame, long_context: DataFrame, split_ttl: Column) -> DataFrame:
    """The cube's rows with use, summed up by keys, day and what decides on their price, then priced part by part."""
    known = cube.filter("n > 0 or i + o + cw + cr > 0").withColumn("_split", split_ttl)
    measures = ["n", "i", "o", "cw", "cr", "cw1h", "cwu"]
    grain = known.groupBy(*dict.fromkeys([*keys, "day", "model", "speed", "lc", "_split"])).agg(*(F.sum(m).alias(m) for m in measures))
    return priced(grain, card, speeds, long_context, F.col("_split"), whole=True)


def _report_sums() -> list[Column]:
    """Turns and tokens are counted at a row's WHOLE part, money at the others."""
    whole = F.col("part") == WHOLE
    once = {"turns": F.col("n"), "tokens": F.col("tokens"), "i": F.col("i"), "o": F.col("o"), "cw": F.col("cw"), "cr": F.col("cr")}
    sums = [F.coalesce(F.sum(F.when(whole, x)), F.lit(0)).cast("bigint").alias(c) for c, x in once.items()]
    return [*sums, F.countDistinct(F.when(whole, F.col("day"))).alias("days"), *(x.alias(c) for c, x in priced_sums().items())]


def history(cube: DataFrame, by: list[str], card: DataFrame, speeds: DataFrame, long_context: DataFrame, split_ttl: Column, first: str | None = None, last: str | None = None, unit: str | None = None) -> DataFrame:
    """(by..., bucket with a unit): turns, tokens, i, o, cw, cr, days, microdollars, unpriced. Bounds in the wrong order are put right.

    One pass: the cube's rows are summed up by what decides on their price, then each is priced part by part, and its turns and tokens
    are counted at its row for all parts. by=[] gives the grand total.
    """
    cube = within(cube, first, last)
    if unit:
        cube, by = cube.withColumn("bucket", bucket(F.col("day"), unit)), [*by, "bucket"]
    return _priced_grain(cube, by, card, speeds, long_context, split_ttl).groupBy(*by).agg(*_report_sums())


def histories(cube: DataFrame, groupings: dict[str, list[str]], card: DataFrame, speeds: DataFrame, long_context: DataFrame, split_ttl: Column, first: str | None = None, last: str | None = None, unit: str | None = None) -> DataFrame:
    """Several reports like `history` in one pass over the cube: (grouping, the keys of all of them, bucket with a unit) and history's sums.

    groupings: the keys of each report by its name; [] is the grand total. Keys that a report does not have are null in its rows. The cube is
    read, summed up and priced once, and the priced rows go into all reports as grouping sets.
    """
    cube = within(cube, first, last)
    keys = list(dict.fromkeys(k for by in groupings.values() for k in by))
    more = ["bucket"] if unit else []
    cube = cube.withColumn("bucket", bucket(F.col("day"), unit)) if unit else cube
    rows = _priced_grain(cube, [*keys, *more], card, speeds, long_context, split_ttl)
    sets = [[*by, *more] for by in groupings.values()]
    out = rows.groupingSets(sets, *keys, *more).agg(F.grouping_id().alias("_set"), *_report_sums())
    every = [*keys, *more]
    number = {name: sum(1 << (len(every) - 1 - i) for i, k in enumerate(every) if k not in by and k not in more) for name, by in groupings.items()}
    name = F.coalesce(*(F.when(F.col("_set") == n, F.lit(x)) for x, n in number.items()))
    return out.select(name.alias("grouping"), *(c for c in out.columns if c != "_set"))


def with_shares(report: DataFrame, total: DataFrame, metric: str, n_days: int) -> DataFrame:
    """report with share (1/100 percent of the metric's grand total, 0 without one), dollars, and the metric for each calendar day of the range, cut to whole numbers.

    total: history's one row with by=[].
    """
    one = F.broadcast(total.select(F.col(metric).alias("_total")))
    share = F.coalesce(F.floor(F.col(metric) * 10_000 / F.nullif("_total", F.lit(0))), F.lit(0)).cast("bigint")
    out = report.join(one).withColumn("share", share).withColumn("a_day", F.floor(F.col(metric) / n_days).cast("bigint"))
    return out.withColumn("dollars", F.round(F.col("microdollars") / 1_000_000, 2).cast("decimal(38,2)")).drop("_total")


def days_between(first: str, last: str) -> int:
    """Calendar days of a range, both ends included."""
    return abs((date.fromisoformat(last) - date.fromisoformat(first)).days) + 1


def unassigned_share(report_by_owner: DataFrame) -> DataFrame:
    """(microdollars, unassigned): all money, and that of turns that belong to no one."""
    none = F.sum(F.when(F.col("owner") == UNASSIGNED, F.col("microdollars")))
    return report_by_owner.agg(F.coalesce(F.sum("microdollars"), F.lit(0)).alias("microdollars"), F.coalesce(none, F.lit(0)).alias("unassigned"))


def buckets_between(first: str, last: str, unit: str) -> Column:
    """array<string>: each bucket from the first day's to the last one's."""
    a, z = sorted((first, last))
    step = {"day": "1 day", "week": "7 days", "month": "1 month"}[unit]
    ends = [F.trunc(F.to_date(F.lit(x)), unit) if unit != "day" else F.to_date(F.lit(x)) for x in (a, z)]
    return F.transform(F.sequence(*ends, F.expr(f"INTERVAL {step}")), lambda d: F.date_format(d, "yyyy-MM-dd"))


def _filled(rows: DataFrame, keys: list[str], axis: DataFrame, measures: list[str]) -> DataFrame:
    held = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), *measures)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return axis.join(held, same, "left").select(*keys, *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))


def bucket_matrix(report: DataFrame, by: list[str], first: str, last: str, unit: str, metrics: list[str]) -> DataFrame:
    """Of a report with a bucket: a row for each group and bucket of the range, 0 where the group has nothing, for a stacked chart."""
    axis = report.select(*by).distinct().select(*by, F.explode(buckets_between(first, last, unit)).alias("bucket"))
    return _filled(report, [*by, "bucket"], axis, metrics)


def ranked(report: DataFrame, by: list[str], metric: str) -> DataFrame:
    return report.orderBy(F.desc(metric), *by)


def drill_down(detail: DataFrame, parent: list[str]) -> DataFrame:
    """Rows of a finer report that have tokens or cost anything, with their share (1/100 percent) of their group's money."""
    rows = detail.filter("tokens > 0 or microdollars > 0")
    total = rows.groupBy(*parent).agg(F.sum("microdollars").alias("_all")).select("_all", *(F.col(k).alias(f"_{k}") for k in parent))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in parent))
    share = F.coalesce(F.floor(F.col("microdollars") * 10_000 / F.nullif("_all", F.lit(0))), F.lit(0)).cast("bigint")
    return rows.join(total, same).withColumn("share", share).drop("_all", *(f"_{k}" for k in parent))


def missing_model(cube: DataFrame) -> DataFrame:
    """(first_day, last_day, tokens) of the rows without a model's name, which have no price; no row where there are none."""
    total = F.sum(F.expr("i + o + cw + cr"))
    out = cube.filter(F.coalesce("model", F.lit("")) == "").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), total.alias("tokens"))
    return out.filter("tokens > 0")


def overlapping(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows with first_day and last_day that overlap a range of days."""
    a, z = sorted((first, last))
    return rows.filter((F.col("last_day") >= a) & (F.col("first_day") <= z))


def by_status(rows: DataFrame) -> DataFrame:
    """Policy: turns and microdollars of each status."""
    return rows.groupBy("status").agg(F.sum("turns").alias("turns"), F.sum("microdollars").alias("microdollars"))


def violations(rows: DataFrame, status: str = "violation") -> DataFrame:
    """Policy: (owner, turns, microdollars, rules) of the rows with a status; rules: array<struct<rule, turns>>.

    A row that breaks several rules counts for each of them, and once in the sums.
    """
    bad = rows.filter(F.col("status") == status)
    each = bad.select("owner", F.explode(F.array_distinct("rules")).alias("rule"), "turns").groupBy("owner", "rule").agg(F.sum("turns").alias("turns"))
    broken = each.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("rule", "turns"))).alias("rules"))
    sums = bad.groupBy("owner").agg(F.sum("turns").alias("turns"), F.sum("microdollars").alias("microdollars"))
    return sums.join(broken, "owner", "left")


def zero_filled(rows: DataFrame, first: str, last: str, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """A row for each day between two days (and for each group of `by`): `day` and the measures, 0 where rows has no such day."""
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1)
    axis = groups.select(*(by or []), F.explode(buckets_between(first, last, "day")).alias("day"))
    return _filled(rows, [*(by or []), "day"], axis, measures)


def write_csv(report: DataFrame, by: list[str], path: str) -> None:
    """A report as one text file for a reader: a byte order mark, a header, quoted keys, credits to four places, ordered by money.

    A report has a row for each group, and is read whole by whoever opens the file.
    """
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [*(quoted(F.col(k)) for k in by), credits(F.col("microdollars")).cast("string"), *(F.col(c).cast("string") for c in ("tokens", "i", "o", "cw", "cr", "turns", "days", "unpriced"))]
    lines = ranked(report, by, "microdollars").select(F.concat_ws(",", *cells).alias("value"))
    names = [*by, "credits", "tokens", "input", "output", "cache writes", "cache reads", "turns", "days", "unpriced tokens"]
    head = report.sparkSession.createDataFrame([("﻿" + ",".join(f'"{n}"' for n in names),)], "value string")
    head.coalesce(1).union(lines.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)
