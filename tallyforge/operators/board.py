"""The announcement board: status by deadline, order, filters, overrides, digests, and sources that fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import replaced

#: Days before a deadline that count as closing soon, days that a closed announcement stays, and days that the last good rows of a source are kept.
SOON, KEEP_CLOSED, KEEP_STALE = 7, 400, 30


def _status(closed: Column, upcoming: Column, ends: Column) -> Column:
    known = lambda x: F.coalesce(x, F.lit(False))
    return F.when(known(closed), "closed").when(known(upcoming), "upcoming").when(known(ends), "open").otherwise("unknown")


def _decorated(rows: DataFrame, status: Column, left: Column) -> DataFrame:
    out = rows.withColumn("status", status)
    out = out.withColumn("dday", F.when(F.col("status").isin("open", "upcoming"), left))
    return out.withColumn("closing_soon", F.coalesce((F.col("status") == "open") & (F.col("dday") <= SOON), F.lit(False)))


def decorated(rows: DataFrame, today: str, now: str) -> DataFrame:
    """rows (apply_start, apply_end, closed_hint) with status, dday and closing_soon; times are text, yyyy-MM-dd[THH:mm].

    As when they were collected: an announcement is open through its last day.
    """
    left = F.datediff(F.to_date(F.substring("apply_end", 1, 10)), F.to_date(F.lit(today)))
    closed = F.coalesce(F.col("closed_hint"), F.lit(False)) | F.coalesce(left < 0, F.lit(False))
    return _decorated(rows, _status(closed, F.col("apply_start") > now, F.col("apply_end").isNotNull()), left)


def decorated_at(rows: DataFrame, now: str) -> DataFrame:
    """The same as seen at a minute (yyyy-MM-ddTHH:mm): an announcement closes at its last minute, 23:59 if it names only a day."""
    minute = lambda c, without: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.translate(F.substring(c, 1, 16), " ", "T")).when(
        F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(F.substring(c, 1, 10), F.lit(f"T{without}"))
    )
    end, start = minute("apply_end", "23:59"), minute("apply_start", "00:00")
    left = F.datediff(F.to_date(F.substring(end, 1, 10)), F.to_date(F.lit(now[:10])))
    closed = F.coalesce(F.col("closed_hint"), F.lit(False)) | F.coalesce(end < now, F.lit(False))
    return _decorated(rows, _status(closed, start > now, end.isNotNull()), left)


def remaining_share(today: str) -> Column:
    """What is left of an announcement's time, 0 to 1; null without both ends or if they are in the wrong order."""
    start, end = (F.to_date(F.substring(c, 1, 10)) for c in ("apply_start", "apply_end"))
    span = F.datediff(end, start)
    return F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.datediff(end, F.to_date(F.lit(today))) / span)))


def _rank() -> Column:
    return F.when(F.col("status") == "open", 0).when(F.col("status") == "upcoming", 1).when(F.col("status") == "unknown", 2).otherwise(3)


def board_order(by: str = "board") -> list[Column]:
    """board: the order of publication. For readers: deadline (the later one first among equals), posted (the latest first) or source."""
    end, posted = F.coalesce("apply_end", F.lit("")), F.coalesce("posted", F.lit(""))
    days = F.coalesce("dday", F.lit(9999))
    return {"board": [_rank(), days, F.desc(F.length(end)), end, posted], "deadline": [_rank(), days, F.desc(end)], "posted": [F.desc(posted)], "source": [F.col("source_label"), _rank()]}[by]


def not_long_closed(rows: DataFrame, cut: str) -> DataFrame:
    return rows.filter((F.col("status") != "closed") | (F.coalesce("apply_end", "posted", F.lit("9999")) >= cut))


def filtered(rows: DataFrame, source: str | None = None, entity: str | None = None, audience: str | None = None, text: str | None = None, fields: list[str] = (), open_only: bool = False) -> DataFrame:
    """What a reader asks for: rows linked from a source, with an entity, for an audience, with a text in one of the fields whatever the case.

    links: array<struct<source, ...>>; fields may be arrays of text. open_only: none that is closed.
    """
    tests = []
    if source:
        tests.append(F.exists("links", lambda x: x["source"] == source))
    if entity:
        tests.append(F.array_contains("entities", entity))
    if audience:
        tests.append(F.col("audience") == audience)
    if text:
        tests.append(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower())))
    if open_only:
        tests.append(F.col("status") != "closed")
    return rows.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def status_counts(rows: DataFrame) -> DataFrame:
    each = {s: F.count_if(F.col("status") == s) for s in ("open", "upcoming", "unknown", "closed")}
    return rows.agg(F.count("*").alias("total"), *(x.alias(s) for s, x in each.items()), F.count_if("closing_soon").alias("closing_soon"))


def filter_values(rows: DataFrame) -> DataFrame:
    """(kind, value, label): the sources that link to rows, with their labels, and the entities, each once."""
    sources = rows.select(F.explode("links").alias("l")).groupBy(F.lit("source").alias("kind"), F.col("l.source").alias("value")).agg(F.min("l.label").alias("label"))
    entities = rows.select(F.lit("entity").alias("kind"), F.explode("entities").alias("value")).distinct().withColumn("label", F.col("value"))
    return sources.unionByName(entities).orderBy("kind", "value")


def unknown_digest(rows: DataFrame, order: list[str], cut: int = 60) -> DataFrame:
    """(token, line, titles): for each unknown token its first line by `order` and the distinct titles that it is in, cut, sorted.

    rows: title, unknown: array<struct<token, line>>, and the columns of order, which are total.
    """
    each = rows.select(*order, "title", F.posexplode("unknown").alias("_pos", "u")).select(*order, "_pos", "title", "u.*")
    out = each.groupBy("token").agg(F.min_by("line", F.struct(*order, "_pos")).alias("line"), F.array_sort(F.collect_set("title")).alias("titles"))
    return out.withColumn("titles", F.transform("titles", lambda t: F.substring(t, 1, cut))).orderBy("token")


def patched(rows: DataFrame, overrides: DataFrame, uid: str, fields: list[str], links: str | None = None, extra: DataFrame | None = None) -> DataFrame:
    """rows with the fields of overrides (by uid; null leaves a field as it is), without those that it hides, and the extra rows.

    links: a column array<struct<source, url>>: an override may also name a link as <source>-<last part of the url>; of several the later
    link's counts, and one for the uid itself before all. With links, `edited` tells which rows were changed.
    """
    o = overrides.select(F.col(uid).alias("_key"), F.struct(F.col("hide").alias("hide"), *fields).alias("_o"))
    if links is None:
        found = rows.join(o, F.col(uid) == F.col("_key"), "left").drop("_key")
    else:
        last = lambda x: F.regexp_extract(F.regexp_replace(x["url"], "/+$", ""), r"([^/]*)$", 1)
        of_links = rows.select(uid, F.posexplode(links).alias("_at", "_l")).select(uid, "_at", F.concat_ws("-", F.col("_l.source"), last(F.col("_l"))).alias("_key"))
        keys = of_links.unionByName(rows.select(uid, F.lit(1 << 30).alias("_at"), F.col(uid).cast("string").alias("_key")))
        best = keys.join(o, "_key").groupBy(F.col(uid).alias("_uid")).agg(F.max_by("_o", "_at").alias("_o"))
        found = rows.join(best, F.col(uid) == F.col("_uid"), "left").drop("_uid").withColumn("edited", F.col("_o").isNotNull())
    kept = found.filter(~F.coalesce("_o.hide", F.lit(False)))
    out = kept.select(*(F.coalesce(f"_o.{c}", c).alias(c) if c in fields else F.col(c) for c in found.columns if c != "_o"))
    return out if extra is None else out.unionByName(extra, allowMissingColumns=True)


def distinct_lines(lines: Column) -> Column:
    """Lines without those whose text, letters and digits only, is within an accepted one or has an accepted one within it."""
    # Each line is made plain once, not for every comparison; a line whose plain text came before goes whatever became of that one.
    each = F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_replace(x, r"(?U)\W", "").alias("plain"))), lambda x: x["plain"] != "")
    clash = lambda acc, x: F.exists(acc, lambda y: F.contains(y["plain"], x["plain"]) | F.contains(x["plain"], y["plain"]))
    kept = F.aggregate(each, F.array().cast("array<struct<line:string,plain:string>>"), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.array_append(acc, x)))
    return F.transform(kept, lambda x: x["line"])


def sources_with_last_good(fresh: DataFrame, report: DataFrame, last_good: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): where a source failed, its last good rows, as stale, up to KEEP_STALE days old.

    fresh: (source, ...); report: (source, error, scanned), error empty if there was none; last_good: (source, saved_at, ...). A source whose list
    was read but had nothing to keep has not failed. The report gets ok, stale, count and collected_at. It has one row for each source, so it is
    sent to the rows: joined by their few sources, they would all meet in as many tasks.
    """
    count = fresh.groupBy("source").agg(F.count("*").alias("_n"))
    state = report.join(count, "source", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ok = (F.coalesce("error", F.lit("")) == "") & ((F.col("_n") > 0) | (F.col("scanned") > 0))
    recent = last_good.filter(F.datediff(F.to_date(F.lit(today)), F.to_date(F.substring("saved_at", 1, 10))) <= KEEP_STALE)
    old = recent.groupBy("source").agg(F.count("*").alias("_old"), F.max("saved_at").alias("_saved"))
    state = state.withColumn("ok", ok).join(old, "source", "left").withColumn("stale", ~F.col("ok") & F.col("_old").isNotNull())
    out = state.withColumn("count", F.when(F.col("ok"), F.col("_n")).otherwise(F.coalesce("_old", F.lit(0)))).withColumn("collected_at", F.when(F.col("stale"), F.col("_saved")).otherwise(""))
    good = fresh.join(F.broadcast(state.filter("ok").select("source")), "source", "left_semi").withColumn("stale", F.lit(False)).withColumn("stale_since", F.lit(""))
    kept = recent.join(F.broadcast(state.filter("stale").select("source")), "source", "left_semi").withColumn("stale", F.lit(True)).withColumnRenamed("saved_at", "stale_since")
    return good.unionByName(kept, allowMissingColumns=True), out.drop("_n", "_old", "_saved")


def saved_last_good(last_good: DataFrame, rows: DataFrame, report: DataFrame, saved_at: str) -> DataFrame:
    """last_good after a run: the rows of the sources that did not fail in place of their older ones."""
    ok = F.broadcast(report.filter("ok").select("source"))
    new = rows.filter(~F.col("stale")).drop("stale", "stale_since").withColumn("saved_at", F.lit(saved_at))
    return last_good.join(ok, "source", "left_anti").unionByName(new.join(ok, "source", "left_semi"), allowMissingColumns=True)


def enabled_sources(config: DataFrame) -> DataFrame:
    """(key, kind, label, list_url, ...) of the sources that are not disabled, each key's last entry."""
    return replaced(config.filter(~F.coalesce("disabled", F.lit(False))), ["key"], ["pos"])


def dday_text(dday: Column) -> Column:
    return F.when(dday == 0, "D-DAY").when(dday > 0, F.concat(F.lit("D-"), dday.cast("string"))).when(dday < 0, F.concat(F.lit("D+"), (-dday).cast("string")))


def period_text(start: Column, end: Column) -> Column:
    """start ~ end, or what there is of it; null without both."""
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(start, F.lit(" ~ "), end)).when(end.isNotNull(), F.concat(F.lit("~ "), end)).when(start.isNotNull(), F.concat(start, F.lit(" ~")))


def closing_soon(rows: DataFrame) -> DataFrame:
    """The banner's list: what closes within days, the next first."""
    return rows.filter("closing_soon").select("uid", "dday", dday_text(F.col("dday")).alias("text")).orderBy("dday", "uid")


def collection_state(report: DataFrame, generated: str, today: str, late_days: int = 2) -> DataFrame:
    """One row: late (the last collection is so many days ago), and the labels of stale sources: those that keep readers out, and the others.

    report: (label, stale, blocked).
    """
    late = F.datediff(F.to_date(F.lit(today)), F.to_date(F.lit(generated[:10]))) >= late_days
    labels = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("label"))))
    stale, blocked = F.col("stale"), F.coalesce("blocked", F.lit(False))
    return report.agg(F.first(late).alias("late"), labels(stale & blocked).alias("blocked"), labels(stale & ~blocked).alias("broken"))
