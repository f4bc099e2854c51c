"""URL filters by association rules: FP-growth mines combinations of URL tokens that go with blocked pages.

Rules pruned by support and confidence are kept in an inverted index by token, which every task matches its URLs with.
Rules written by hand (host, path, verdict) come before mined ones.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Mined from about so many labelled pages.
SAMPLE = 200_000
#: A rule holds for at least this share of the labelled pages, and this many of them; this share of those it holds for are blocked.
SUPPORT, LEAST_PAGES, CONFIDENCE = 0.001, 8, 0.8
BLOCKED = "=block"
#: Rules in one index of a task; more of them take several.
BLOCK = 100_000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens: h=<label of the host>, p=<part of the path, numbers as 0> and q=<name in the query>."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    hosts = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h="), x))
    parts = F.transform(F.split(F.regexp_replace(F.lower(path(url)), r"\d+", "0"), "[^a-z0-9]+"), lambda x: F.concat(F.lit("p="), x))
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.filter(F.concat(hosts, parts, names), lambda x: F.length(x) > 2))


def verdict_of_rules(url: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; rules: (verdict, host, path without its first /)."""
    h, p = host(url), path(url)
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == name) | h.endswith(f".{name}")) & p.startswith(f"/{start}")
        rule = F.when(fits, F.lit(f"{name}/{start}")).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], float, float]]:
    """(tokens, support, confidence) of the rules tokens -> block, by confidence, support and brevity; labelled: (tokens array<string>, block boolean).

    The rules of longer token lists are left out where a sublist's rule is as confident. All other rules with that support and
    confidence are there. Tokens that stand in the same rows are mined as one item, which loses nothing: the rule of any
    of their combinations holds for the same rows as that of one of them, so each of them takes the item's place in turn.
    """
    total = labelled.count()
    if not total:
        return []
    share = max(support, LEAST_PAGES / total)
    if share > 1:
        return []
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("_row"), "tokens", "block"))
    each = rows.select("_row", F.explode("tokens").alias("token"))
    # Tokens of blocked pages only can be in a rule; as frequent ones they are fewer than the tokens of a page / share.
    often = (
        rows.select("block", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"), F.count_if("block").alias("k"))
        .filter((F.col("k") >= share * total) & (F.col("n") < total))
    )
    rows_of = each.join(stored(often).select("token"), "token")
    # The same rows: the same number of them and the same sums of two hashes of each.
    sums = [F.sum(F.xxhash64("_row", F.lit(i)).cast("decimal(38,0)")).alias(f"_{i}") for i in (1, 2)]
    alike = rows_of.groupBy("token").agg(F.count("*").alias("n"), *sums)
    groups = stored(alike.groupBy("n", "_1", "_2").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("token"), "members"))
    members = {r.token: r.members for r in groups.collect()}
    items = rows_of.join(groups.select("token"), "token").groupBy("_row").agg(F.collect_list("token").alias("items")).join(rows.select("_row", "block"), "_row")
    items = items.select(F.when(F.col("block"), F.array_append("items", BLOCKED)).otherwise(F.col("items")).alias("items"))
    n_items = items.count()
    if not n_items:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, share * total / n_items), minConfidence=confidence).fit(items)
    found = stored(model.associationRules.filter(F.array_contains("consequent", BLOCKED)).select(F.array_sort("antecedent").alias("own"), "support", "confidence"))
    # A rule whose sublist's is as confident goes, before anything is sent; a sublist is not longer, so all its items are in the longer one.
    sizes = [r[0] for r in found.select(F.size("own")).distinct().orderBy(F.size("own")).collect()]
    kept: list[tuple[tuple[str, ...], float, float]] = []
    by_item: dict[str, list[int]] = defaultdict(list)
    for size in sizes:
        new = []
        for r in found.filter(F.size("own") == size).toLocalIterator():
            own = set(r.own)
            near = Counter(k for t in own for k in by_item.get(t, ()))
            if not any(n == len(kept[k][0]) and kept[k][2] >= r.confidence for k, n in near.items()):
                new.append((tuple(r.own), r.support * n_items / total, r.confidence))
        for rule in new:
            for t in rule[0]:
                by_item[t].append(len(kept))
            kept.append(rule)
    whole = [(tuple(sorted(x)), s, c) for own, s, c in kept for x in product(*(members[t] for t in own))]
    return sorted(whole, key=lambda r: (-r[2], -r[1], len(r[0]), r[0]))


class Index:
    """Rules by token: a URL's tokens count up the rules they are in, and a rule whose count is its length matches."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float, float]]):
        self.rules, self.by_token = rules, defaultdict(list)
        for k, (antecedent, _, _) in enumerate(rules):
            for t in antecedent:
                self.by_token[t].append(k)

    def best(self, own: list[str]) -> int | None:
        """The first rule, in the order of the list, that has all its tokens in own (distinct)."""
        hits = Counter(k for t in own for k in self.by_token.get(t, ()))
        return min((k for k, n in hits.items() if n == len(self.rules[k][0])), default=None)


def matched(own: Column, rules: list[tuple[tuple[str, ...], float, float]], block: int = BLOCK) -> Column:
    """Of the tokens in own: the first matching rule as struct<tokens, confidence>, or null. Each index holds `block` rules at most."""
    parts = [rules[i : i + block] for i in range(0, len(rules), block)]
    return F.coalesce(*(_match(x)(own) for x in parts or [[]]))


def _match(rules: list[tuple[tuple[str, ...], float, float]]):
    index = Index(rules)
    kind = pa.struct([("tokens", pa.list_(pa.string())), ("confidence", pa.float64())])

    @F.arrow_udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())]))
    def match(lists: pa.Array) -> pa.Array:
        best = [index.best(x) for x in lists.to_pylist()]
        return pa.array([None if k is None else {"tokens": list(rules[k][0]), "confidence": rules[k][2]} for k in best], kind)

    return match


def _labelled(pages: DataFrame, labels: DataFrame, bad: Column, id_col: str, url_col: str, label_id: str) -> DataFrame:
    """(id, url, block) of the pages with a label; several labels of an id count as the bad one."""
    known = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg((F.coalesce(F.max(bad.cast("int")), F.lit(0)) == 1).alias("block"))
    return pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).join(known, "_id")


def url_filter(
    pages: DataFrame, labels: DataFrame | None, bad: Column | None, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rows: int = SAMPLE
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule (struct, null where none matches).

    A page is labelled where labels has its id; several labels count as the bad one, null ids and null labels as none. Without
    a table of labels (None), the verdicts of `rules` are the labels of the pages that they fit.
    A fitting rule of `rules` decides, else a mined rule blocks, else the page is allowed. A null url has an empty host
    and path and is allowed unless mined rules say otherwise; repeated rows give repeated rows; empty tables give no
    rows, or no mined rules. Only mining is bounded: about `rows` labelled pages, picked by a hash of the url.
    """
    url = F.col("_url")
    rule, verdict = verdict_of_rules(url, rules)
    if labels is None:
        known = pages.select(F.col(url_col).cast("string").alias("_url")).select("_url", (verdict == "block").alias("block")).filter("block is not null")
    else:
        known = _labelled(pages, labels, bad, id_col, url_col, label_id)
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("_url", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    found = mined(known.select(tokens(url).alias("tokens"), "block"))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    out = out.select("page_id", host(url).alias("host"), path(url).alias("path"), rule.alias("rule"), verdict.alias("_verdict"), tokens(url).alias("_tokens"))
    out = out.withColumn("mined_rule", matched(F.col("_tokens"), found))
    final = F.coalesce("_verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), "mined_rule")
