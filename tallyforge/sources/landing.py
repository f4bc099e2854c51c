"""Announcements from pages that were landed in a folder: lists of JSON, tables, and lists of whatever structure, by configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as X
from ..operators.board import enabled_sources


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """(path, source, markup): a row per landed file, whole; source: the folder that it is in."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(f"{path}/*")
    name = F.col("_metadata.file_path")
    return raw.select(name.alias("path"), F.element_at(F.split(name, "/"), -2).alias("source"), F.col("value").alias("markup"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of landed attachments; the text is empty where no reader fits."""
    raw = spark.read.format("binaryFile").load(f"{path}/*")
    return raw.select("path", P.document_text(F.col("content")).alias("text"))


def api_rows(pages: DataFrame, schema: str, at: str) -> DataFrame:
    """pages (source, body) of JSON as a row per element of the list at `at` (a path within schema), with source; bodies that are no JSON give none."""
    return pages.select("source", F.from_json("body", schema).alias("b")).select("source", F.explode(f"b.{at}").alias("r")).select("source", "r.*")


def table_rows(markup: Column, row: str = r"(?is)<tr\b[^>]*>(.*?)</tr>", cell: str = r"(?is)<td\b[^>]*>(.*?)</td>") -> Column:
    """array<array<string>>: the cells of each row of a page's tables, their markup kept; rows without cells are left out."""
    rows = F.transform(F.regexp_extract_all(markup, F.lit(row), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit(cell), F.lit(1)))
    return F.filter(rows, lambda r: F.size(r) > 0)


def listed(pages: DataFrame, config: DataFrame, least: int = 5) -> DataFrame:
    """(source, label, title, url, ident, posted, text) of the rows of landed lists; one row for each identifier of a source, the first.

    pages: (source, page, markup); config: (key, label, list_url, page_param, detail_url). The address is the row's own without a session, else that
    of the template with the row's number; rows without either are left out.
    """
    c = config.select(F.col("key").alias("source"), "label", "list_url", "page_param", "detail_url")
    joined = pages.join(F.broadcast(c) if config.limit(10_001).count() <= 10_000 else c, "source")
    base = X.page_url(F.col("list_url"), F.col("page_param"), F.col("page"))
    rows = joined.select("source", "label", "detail_url", "page", F.posexplode(P.list_rows(F.col("markup"), base, least)).alias("pos", "r")).select("source", "label", "detail_url", "page", "pos", "r.*")
    url = X.without_session(F.when(F.col("url") != "", F.col("url")).otherwise(X.detail_url(F.col("detail_url"), F.col("number"))))
    rows = rows.withColumn("url", url).withColumn("ident", F.coalesce(F.nullif("number", F.lit("")), F.col("url"))).filter("url <> ''")
    first = F.min_by(F.struct("label", "title", "url", "posted", "text"), F.struct("page", "pos"))
    return rows.groupBy("source", "ident").agg(first.alias("_r")).select("source", "ident", "_r.*")


def scanned(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, pages, scanned): what was landed and read of each source, for the report of failures."""
    n = rows.groupBy("source").agg(F.count("*").alias("scanned"))
    return pages.groupBy("source").agg(F.count("*").alias("pages")).join(n, "source", "left").withColumn("scanned", F.coalesce("scanned", F.lit(0)))


def announced(rows: DataFrame, bodies: DataFrame, *, wanted: str, unwanted: str, keys: str, date_like: str, deadline: str, closed: str, supplier: str) -> DataFrame:
    """Records of listed rows that are relevant by their title, with what their bodies (url, body) tell: the time to apply, the audience, a summary."""
    kept = rows.filter(X.relevant(F.col("title"), F.lit(None).cast("string"), wanted, unwanted)).join(bodies, "url", "left")
    body = F.coalesce("body", F.lit(""))
    period = X.apply_period(F.concat_ws("\n", "title", body), keys, date_like, deadline, F.nullif(F.substring("posted", 1, 4), F.lit("")))
    uid = F.concat_ws("-", "source", F.substring(F.regexp_replace("ident", r"[^A-Za-z0-9_-]", ""), 1, 40))
    return kept.select(
        "source", F.col("label").alias("source_label"), uid.alias("uid"), "title", "url", "posted", period["start"].alias("apply_start"), period["end"].alias("apply_end"),
        F.col("title").rlike(closed).alias("closed_hint"), X.label_by(supplier, "supplier", "user", F.col("title"), F.substring(body, 1, 2000)).alias("audience"), X.first_long_line(body, 45, 200).alias("summary"),
    )


def collected(pages: DataFrame, config: DataFrame, connectors: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """The listed rows of all enabled sources: each kind of source goes through its connector, (pages, config) -> the columns of `listed`.

    config: (key, kind, disabled, pos, ...); pages: (source, page, markup). A source of an unknown kind gives no rows.
    """
    enabled = enabled_sources(config)
    parts = []
    for kind, connector in connectors.items():
        own = enabled.filter(F.col("kind") == kind)
        parts.append(connector(pages.join(own.select(F.col("key").alias("source")), "source", "left_semi"), own))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
