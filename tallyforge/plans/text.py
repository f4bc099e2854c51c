"""Text extraction over announcements made of orders, over documents and over pages, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as X
from ..functions.extract import Patterns
from ..operators import board
from ..sources.events import table

ENTITY = r"(?<![A-Za-z0-9])(?:AB100|CD200|EF300|GH400)(?![A-Za-z0-9])"
PATTERNS = Patterns(
    entity=ENTITY, quantity=r"\d+\s*cards?", labels=(("Ab-100", "AB100"),), weights=((r"\(\s*\d+ cards", 3), (r"won", -9)), cost=r"fee", cost_needs=r"\d|free", bare=r"^\d+ won$", cost_weights=((r"won", 4), (r"free", 2)),
    audiences=(("academy", "Universit"), ("industry", "Compan")), exempt=("fee", "free"),
)
DATE_LIKE = r"\d{4}[.\-]\d{1,2}[.\-]\d{1,2}"


def body(k: Column, d: Column) -> Column:
    """An announcement's text made of an order's key and date."""
    n = lambda x: x.cast("string")
    day = lambda x, f: F.date_format(x, f)
    later = F.date_add(F.to_date(d), (k % 20).cast("int"))
    use = F.when(k % 3 == 0, F.concat(F.lit("Period of use "), day(d, "yyyy-MM-dd"), F.lit(" ~ "), day(later, "yyyy.M.d"))).when(k % 3 == 1, F.concat(F.lit("* Period of use until "), day(later, "yyyy.M.d"))).otherwise(F.lit("Period of use about 5 months"))
    return F.concat_ws(
        "\n", F.concat(F.lit("Call "), n(k % 100), F.lit("  for partners")), F.lit("1. Contents and fee of the call 12"), F.concat(F.lit("Apply: "), day(d, "yyyy.MM.dd"), F.lit(" 10:00 ~ "), day(later, "M.d")), use,
        F.concat(F.lit("AB100("), n(k % 4 + 2), F.lit(" cards), CD200/EF300(1 card, "), n(k % 3 + 2), F.lit(" cards)")), F.lit("GH400"), F.concat(n(k % 5 + 2), F.lit(" cards each")), F.lit("(Universities) fee 0 won, free of charge"),
        F.concat(F.lit("(Companies) fee "), n(k % 9 * 10), F.lit(" won a month")), F.lit("2. Scale"), F.concat(F.lit("Scale: "), n(k % 50), F.lit(" units in total")), F.concat(F.lit("Server ZX"), n(k % 50 + 10), F.lit(" node")), F.lit("No.QQ11 server"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements made of orders: a small file, but much work for each row, so keys and dates are dealt over the tasks."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return orders.select(F.col("o_orderkey").alias("k"), body(F.col("o_orderkey"), F.col("o_orderdate")).alias("text"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    apply = X.apply_period(text, "^Apply", DATE_LIKE, r"Deadline:? *(\d{4}\.\d+\.\d+)", F.lit(None).cast("string"))
    use = X.usage_period(text, "Period of use", "Apply", DATE_LIKE, "until|~", "month")
    both = calls(spark, sf_dir).withColumn("a", apply).withColumn("u", use)
    return both.select("k", F.col("a.start").alias("apply_start"), F.col("a.end").alias("apply_end"), F.col("u.text").alias("use"), F.col("u.start").alias("use_start"), F.col("u.end").alias("use_end"))


PERIODS_SQL = """WITH c AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 20) AS z FROM orders)
SELECT k, strftime(d, '%Y-%m-%d') || 'T10:00' AS apply_start, CASE WHEN NOT (month(z) = 2 AND day(z) = 29 AND year(d) <> year(z)) THEN year(d) || strftime(z, '-%m-%d') END AS apply_end,
  CASE k % 3 WHEN 0 THEN 'Period of use ' || strftime(d, '%Y-%m-%d') || ' ~ ' || strftime(z, '%Y.%-m.%-d') WHEN 1 THEN 'Period of use until ' || strftime(z, '%Y.%-m.%-d') ELSE 'Period of use about 5 months' END AS use,
  CASE WHEN k % 3 = 0 THEN strftime(d, '%Y-%m-%d') END AS use_start, CASE WHEN k % 3 < 2 THEN strftime(z, '%Y-%m-%d') END AS use_end FROM c"""


def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their quantities, at most two rows of each and eight of a text."""
    each = F.transform(X.specs(F.col("text"), PATTERNS), lambda s: F.concat_ws("=", s["entity"], s["quantity"]))
    return calls(spark, sf_dir).select("k", F.array_join(each, "; ").alias("specs"))


TOPK_SQL = """SELECT o_orderkey AS k, 'Ab-100=' || (o_orderkey % 4 + 2) || ' cards; CD200=1 card, ' || (o_orderkey % 3 + 2) || ' cards; EF300=1 card, ' || (o_orderkey % 3 + 2) || ' cards; GH400=' || (o_orderkey % 5 + 2) || ' cards each' AS specs FROM orders"""


def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.transform(X.costs(F.col("text"), PATTERNS), lambda s: F.concat_ws(": ", s["audience"], s["text"]))
    return calls(spark, sf_dir).select("k", F.array_join(each, "; ").alias("costs"))


COSTS_SQL = "SELECT o_orderkey AS k, 'academy: fee 0 won, free of charge; industry: fee ' || (o_orderkey % 9 * 10) || ' won a month' AS costs FROM orders"


def scale_and_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    known = X.entities(text, f"({ENTITY})")
    tokens = X.unknown_tokens(text, r"[A-Z]{2}\d{2,4}", "(?i)server|cards", known, "^NO", r"No\.$")
    return calls(spark, sf_dir).select("k", F.array_join(X.scale_lines(text, "Scale", r"\d+ units"), "; ").alias("scale"), F.array_join(F.transform(tokens, lambda t: F.concat_ws("@", t["token"], t["line"])), "; ").alias("unknown"))


SCALE_SQL = "SELECT o_orderkey AS k, 'Scale: ' || (o_orderkey % 50) || ' units in total' AS scale, 'ZX' || (o_orderkey % 50 + 10) || '@Server ZX' || (o_orderkey % 50 + 10) || ' node' AS unknown FROM orders"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, ordinals, names in brackets, entities under labels and a label by a keyword, of titles made of parts."""
    k = F.col("p_partkey")
    title = F.concat(F.lit("24-"), (k % 5).cast("string"), F.lit("th round ["), F.col("p_brand"), F.lit("] "), F.col("p_type"), F.when(k % 4 == 0, F.lit(" closed")).otherwise(F.lit("")))
    t = table(spark, sf_dir, "part").select(k.alias("k"), title.alias("title"))
    x = F.col("title")
    return t.select(
        "k", X.first_tag(x, {"steel": "(?i)steel", "metal": "(?i)brass|copper|nickel|tin"}).alias("tag"), X.group_of(x, r"(\d{2}-\d+)th").alias("nth"), X.name_in_title(x, r"\[([^\]]+)\]", r"(\w+) round").alias("name"),
        x.rlike("closed").alias("closed_hint"), X.label_by("(?i)economy", "low", "high", x).alias("class"), F.array_join(X.labelled_entities(x, r"(?i)\b([a-z]+)\b", {"Metal": "brass|copper|nickel|tin|steel", "Any": "round|th|brand"}, {"Any": ["Metal"]}), ",").alias("entities"),
    )


TAGS_SQL = r"""WITH t AS (SELECT p_partkey AS k, p_brand, '24-' || p_partkey % 5 || 'th round [' || p_brand || '] ' || p_type || CASE WHEN p_partkey % 4 = 0 THEN ' closed' ELSE '' END AS x FROM part),
w AS (SELECT *, list_transform(regexp_extract_all(x, '(?i)\b([a-z]+)\b', 1), lambda y: CASE WHEN lower(y) IN ('brass', 'copper', 'nickel', 'tin', 'steel') THEN 'Metal' WHEN lower(y) IN ('round', 'th', 'brand') THEN 'Any' ELSE upper(y) END) AS n FROM t),
d AS (SELECT *, list_filter(n, lambda e, i: list_position(n, e) = i AND NOT (e = 'Any' AND list_contains(n, 'Metal'))) AS e FROM w)
SELECT k, CASE WHEN regexp_matches(x, '(?i)steel') THEN 'steel' WHEN regexp_matches(x, '(?i)brass|copper|nickel|tin') THEN 'metal' END AS tag, '24-' || k % 5 AS nth, p_brand AS name, k % 4 = 0 AS closed_hint,
  CASE WHEN regexp_matches(x, '(?i)economy') THEN 'low' ELSE 'high' END AS class, array_to_string(e, ',') AS entities FROM d"""


def containment_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document, the second of them once more with marks."""
    own = X.lines(F.col("text"))
    doubled = F.concat(own, F.transform(F.slice(own, 2, 1), lambda x: F.concat(F.lit("- "), x, F.lit("!"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(board.distinct_lines(doubled), "\n").alias("lines"))


CONTAINMENT_SQL = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')), lambda x: x <> '') AS x FROM documents),
d AS (SELECT doc_id, list_concat(x, CASE WHEN len(x) > 1 THEN ['- ' || x[2] || '!'] ELSE [] END) AS x FROM l),
p AS (SELECT doc_id, list_filter(list_transform(x, lambda y: {'line': y, 'plain': regexp_replace(y, '[^\p{L}\p{N}_]', '', 'g')}), lambda y: y.plain <> '') AS x FROM d)
SELECT doc_id, CASE WHEN len(x) = 0 THEN '' ELSE array_to_string(list_transform(list_reduce(list_transform(x, lambda y: [y]), lambda acc, y:
  CASE WHEN len(list_filter(acc, lambda z: contains(z.plain, y[1].plain) OR contains(y[1].plain, z.plain))) > 0 THEN acc ELSE list_concat(acc, y) END), lambda z: z.line), chr(10)) END AS lines FROM p"""


def first_long_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_long_line(F.col("text"), 45, 200).alias("line"))


FIRST_LONG_SQL = "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 45)[1][1:200] AS line FROM documents"


def local_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with an offset, in UTC, without one, and none."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    at = F.date_format(F.timestamp_add("MINUTE", (k % 1440).cast("int"), d), "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(k % 4 == 0, F.concat(at, F.lit(".000+00:00"))).when(k % 4 == 1, F.concat(at, F.lit("Z"))).when(k % 4 == 2, at).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.local_minute(iso).alias("at"))


LOCAL_MINUTES_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M') END AS at FROM orders"


def readable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    error = F.when(k % 4 == 0, F.concat(F.lit("Read timed out after "), (k % 60).cast("string"))).when(k % 4 == 1, F.concat(F.lit("50"), (k % 5).cast("string"), F.lit(" Server Error"))).when(k % 4 == 2, F.repeat(F.lit("odd\n "), 40)).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.readable_error(error, [X.Message("timed out", "The site does not answer.")]).alias("message"))


ERRORS_SQL = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'The site does not answer.' WHEN 1 THEN 'The server answered HTTP 50' || o_orderkey % 5 WHEN 2 THEN repeat('odd ', 30)[1:117] || '…' ELSE '' END AS message FROM orders"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.page_title(F.col("html")).alias("title"))


TITLES_SQL = r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g'), ' ') AS title FROM pages"


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links joined with their page's address, pages of a list, and addresses without a session."""
    link = F.explode(X.links(F.col("html"))).alias("link")
    p = table(spark, sf_dir, "pages").select("page_id", "url", link)
    n = F.col("page_id") % 3 + 1
    return p.select(
        "page_id", "link", X.joined_url(F.col("url"), F.col("link")).alias("joined"), X.page_url(F.regexp_replace("url", "#.*$", ""), F.lit("p"), n).alias("listed"),
        X.without_session(F.concat(F.lit("https://a.test/b;jsessionid="), "page_id", F.lit("?x=1"))).alias("clean"), X.detail_url(F.lit("https://a.test/{id}"), F.col("page_id").cast("string")).alias("detail"),
    )


ADDRESSES_SQL = r"""WITH l AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS link FROM pages), u AS (SELECT *, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site, regexp_replace(url, '#.*$', '') AS bare FROM l)
SELECT page_id, link, CASE WHEN regexp_matches(link, '^[a-z]+:') THEN link WHEN link LIKE '//%' THEN 'https:' || link WHEN link LIKE '/%' THEN site || link WHEN link LIKE '#%' THEN bare || link ELSE regexp_replace(regexp_replace(bare, '\?.*$', ''), '[^/]*$', '') || link END AS joined,
  CASE WHEN page_id % 3 = 0 THEN bare ELSE bare || CASE WHEN bare LIKE '%?%' THEN '&' ELSE '?' END || 'p=' || (page_id % 3 + 1) END AS listed, 'https://a.test/b?x=1' AS clean, 'https://a.test/' || page_id AS detail FROM u"""


def board_link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(X.board_links(F.col("html"), F.col("url"), "(?i)the|and"), lambda r: F.concat_ws(" ", r["text"], r["url"]))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, "; ").alias("boards"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation of a page with dates put in, as a list that repeats."""
    dated = F.regexp_replace("html", r"</a></li>", " of this page</a> 2024.3.7</li>")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(P.list_rows(dated, F.col("url"))).alias("pos", "r"))
    return rows.select("page_id", "pos", "r.title", "r.url", "r.posted")


PAGE_ROWS_SQL = r"""WITH l AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS t FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS pos, t[i] || ' of this page' AS title, site || h[i] AS url, '2024-03-07' AS posted FROM l, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i) WHERE len(h) >= 5"""

QUERIES = {
    "periods": periods, "topk_per_key": topk_per_key, "cost_lines": cost_lines, "scale_and_unknown_tokens": scale_and_unknown, "title_tags": tags, "containment_dedupe": containment_dedupe, "first_long_line": first_long_line,
    "local_minutes": local_minutes, "readable_errors": readable_errors, "page_title": page_titles, "page_addresses": page_addresses, "board_links": board_link_list, "page_rows": page_rows,
}
SQL = {
    "periods": PERIODS_SQL, "topk_per_key": TOPK_SQL, "cost_lines": COSTS_SQL, "scale_and_unknown_tokens": SCALE_SQL, "first_long_line": FIRST_LONG_SQL, "local_minutes": LOCAL_MINUTES_SQL, "readable_errors": ERRORS_SQL, "page_title": TITLES_SQL,
    "page_addresses": ADDRESSES_SQL, "page_rows": PAGE_ROWS_SQL, "title_tags": TAGS_SQL, "containment_dedupe": CONTAINMENT_SQL,
}
