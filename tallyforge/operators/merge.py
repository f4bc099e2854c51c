"""Merging of announcements that several sources post."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .order import placed_within

#: Least similarity of two names; days by which the starts or the ends of one announcement may differ.
ALIKE, START_GAP, END_GAP = 0.9, 7, 45
#: Names that may differ by up to so many characters are found by groups of characters, longer ones by their rare pairs of characters.
MOST_GROUPED = 8
#: Longs of a name's bag, in which a character sets a bit for each of its uses.
BAG = 4
#: Rows of a key that meet all others of it in one task.
HOT = 2000
#: Records of a block that are settled at once.
CHUNK = 1 << 14


def _bag(core: str) -> list[int]:
    bits, seen = np.zeros(64 * BAG, bool), Counter()
    for c in core:
        bits[crc32(f"{c}{seen[c]}".encode()) % (64 * BAG)] = True
        seen[c] += 1
    return np.packbits(bits).view(np.int64).tolist()


def _differing(least: float, size: int) -> set[int]:
    """How many characters, of both together, may be unmatched in a text of that size and its partners."""
    lengths = range(int(size * least / (2 - least)), int(size * (2 - least) / least) + 2)
    return {int((1 - least) * (size + n) + 1e-9) for n in lengths}


def group_keys(core: str, least: float) -> list[str]:
    """Keys of which two texts of a ratio of `least` share one at least, where no more than MOST_GROUPED characters differ.

    Unmatched characters are at most d = (1 - least) times both lengths. The characters are dealt into d + 2 groups by a hash, and at most
    d of the groups hold an unmatched one: two groups are equal as bags. A key is a pair of groups, for each d that partners may have.
    """
    out = []
    for d in _differing(least, len(core)):
        if d <= MOST_GROUPED:
            groups: list[list[str]] = [[] for _ in range(d + 2)]
            for c in core:
                groups[crc32(c.encode()) % (d + 2)].append(c)
            whole = ["".join(sorted(g)) for g in groups]
            out += [f"{d}|{i}|{j}|{whole[i]}|{whole[j]}" for i, j in combinations(range(d + 2), 2)]
    return out


def _rare_pairs(names: DataFrame, least: float) -> DataFrame:
    """(core, key): the rarest pairs of neighbouring characters of long texts; two texts of a ratio of `least` share one.

    The ratio is twice the matched characters over the sum of the lengths, T. Unmatched are at most (1 - least) T characters, so the matched
    ones stand in at most one block more than that, and two neighbours in a block are a pair of characters that both texts have: they
    share at least least T / 2 - (1 - least) T - 1 of them. Pairs are numbered where they repeat, and each text is looked up by its
    rarest ones only, one more than it may lack.
    """
    size = F.length("core")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(F.col("core"), i, F.lit(2)))
    each = names.filter(size * (1 + (2 - least) / least) * (1 - least) >= MOST_GROUPED).select("core", F.posexplode(grams).alias("_i", "g"))
    nth = F.row_number().over(Window.partitionBy("core", "g").orderBy("_i"))
    each = stored(each.select("core", F.concat_ws("#", "g", nth.cast("string")).alias("g")))
    often = each.groupBy("g").agg(F.count("*").alias("_df"))
    # The partner is no shorter than least / (2 - least) of this text, so this is the least that both share.
    both = size * (1 + least / (2 - least))
    must = F.greatest(F.lit(1), F.ceil(both * (least / 2 - (1 - least)) - 1 - 1e-9))
    ranked = each.join(often, "g").withColumn("_r", F.row_number().over(Window.partitionBy("core").orderBy("_df", "g")))
    return ranked.filter(F.col("_r") <= F.greatest(size - 1, F.lit(1)) - must + 1).select("core", F.col("g").alias("key"))


def _may_be_alike(least: float) -> Column:
    """Whether the lengths and the bags of a and b allow the ratio. A bit that one bag lacks stands for an unmatched character or more."""
    matched = least / 2 * (F.length("a") + F.length("b")) - 1e-9
    lacks = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BAG)), F.lit(0))
    return (F.least(F.length("a"), F.length("b")) >= matched) & (F.length("a") - lacks("_a", "_b") >= matched) & (F.length("b") - lacks("_b", "_a") >= matched)


def candidate_pairs(names: DataFrame, least: float = ALIKE) -> DataFrame:
    """(a, b), a < b, each once: pairs of the distinct texts `core` that can have a ratio of `least` (above 2/3); none that has is missing.

    Texts meet by a shared key (`group_keys`; long ones `_rare_pairs`), and a pair whose lengths or bags of characters deny the ratio is
    dropped within the join. Of a key with very many texts, each task meets HOT of them with all others.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"core": pdf["core"], "bag": pdf["core"].map(_bag), "keys": pdf["core"].map(lambda x: group_keys(x, least))})

    made = stored(names.mapInPandas(keyed, "core string, bag array<long>, keys array<string>"))
    keys = made.select("core", "bag", F.explode("keys").alias("key")).withColumn("key", F.xxhash64("key"))
    rare = _rare_pairs(names, least).select("core", F.xxhash64("key").alias("key"))
    keys = stored(keys.unionByName(rare.join(made.select("core", "bag"), "core")).distinct())
    parts = stored(keys.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("_parts"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    shared = keys.join(parts, "key")
    left = shared.select("key", F.col("core").alias("a"), F.col("bag").alias("_a"), F.pmod(F.hash("core"), "_parts").alias("_part"))
    right = shared.select("key", F.col("core").alias("b"), F.col("bag").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, ["key", "_part"]).filter((F.col("a") < F.col("b")) & _may_be_alike(least)).select("a", "b").distinct()


def alike(pairs: DataFrame, least: float = ALIKE) -> DataFrame:
    """(core, other): the ordered pairs whose SequenceMatcher ratio, with core as the first text, is at least `least`: it depends on the order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x for a, b in zip(pdf["a"], pdf["b"], strict=True) for x in ((a, b), (b, a))]
            yield pd.DataFrame([x for x in rows if SequenceMatcher(None, *x).ratio() >= least], columns=["core", "other"])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table, but much work
    return pairs.repartition(tasks, "a", "b").mapInPandas(run, "core string, other string")


def blocks(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(core, block): the smallest text that a text is linked with over any number of the pairs (core, other); rounds of stored tables."""
    both = stored(pairs.select("core", "other").union(pairs.select("other", "core")).distinct())
    label = stored(names.select("core", F.col("core").alias("block")))
    while True:
        near = both.join(label.select(F.col("core").alias("other"), F.col("block").alias("_near")), "other").groupBy("core").agg(F.min("_near").alias("_near"))
        step = label.join(near, "core", "left").select("core", "block", F.least("block", F.coalesce("_near", "block")).alias("_best"))
        # Then to where that text itself has gone.
        up = label.select(F.col("core").alias("_best"), F.col("block").alias("_up"))
        step = stored(step.join(up, "_best").select("core", "block", F.least("_best", "_up").alias("_to")))
        if step.filter("_to < block").isEmpty():
            return label
        label = stored(step.select("core", F.col("_to").alias("block")))


def _gap(a, b) -> int:
    if not a or not b:
        return 0
    return abs((pd.Timestamp(a[:10]) - pd.Timestamp(b[:10])).days)


def same_announcement(x: dict, y: dict, tags: list[str], least: float = ALIKE) -> bool:
    """Two records: other sources, like names, no tag or ordinal that both have and that differs, and dates near enough."""
    if x["source"] == y["source"] or not x["core"] or not y["core"] or any(x[t] and y[t] and x[t] != y[t] for t in [*tags, "nth"]):
        return False
    if _gap(x["apply_start"], y["apply_start"]) > START_GAP and _gap(x["apply_end"], y["apply_end"]) > END_GAP:
        return False
    return x["core"] == y["core"] or SequenceMatcher(None, x["core"], y["core"]).ratio() >= least


def settled(records: pd.DataFrame, links: pd.DataFrame, tags: list[str]) -> pd.Series:
    """The group of each record without one, in the order of `place`; records with one were settled before, and groups are numbers.

    links (core, other): names that are alike. A group is its first record's place. A record joins the first group all of whose members are
    the same announcement: their number among the members that are is the group's size.
    """
    records = records.sort_values(["group", "place"], na_position="last")
    n, names = len(records), pd.Index(records["core"].unique())
    near = np.eye(len(names), dtype=bool) if len(names) <= 4096 else None
    own, other = names.get_indexer(links["core"]), names.get_indexer(links["other"])
    known = (own >= 0) & (other >= 0)
    own, other = own[known], other[known]
    if near is not None:
        near[own, other] = True
    order = np.argsort(own, kind="stable")
    own, other = own[order], other[order]

    def near_row(name: int) -> np.ndarray:
        if near is not None:
            return near[name]
        row = np.zeros(len(names), bool)
        row[other[np.searchsorted(own, name) : np.searchsorted(own, name, "right")]] = True
        row[name] = True
        return row

    name = names.get_indexer(records["core"])
    source = pd.factorize(records["source"])[0]
    marks = [pd.factorize(records[t].replace("", None))[0] for t in [*tags, "nth"]]
    days = [pd.to_datetime(records[c].str.slice(0, 10), format="%Y-%m-%d", errors="coerce").to_numpy("datetime64[D]").astype(float) for c in ("apply_start", "apply_end")]
    for d in days:
        d[d < -1e15] = np.nan  # no date
    first = int(records["group"].notna().sum())
    starts, group = np.unique(records["group"].to_numpy()[:first].astype(np.int64), return_inverse=True)
    starts, group, size = starts.tolist(), np.concatenate((group, np.zeros(n - first, np.int64))), np.bincount(group, minlength=1).tolist()
    size = np.array(size + [0] * (n - first + 1), np.int64)
    place = records["place"].to_numpy()
    for i in range(first, n):
        same = near_row(name[i])[name[:i]] & (source[:i] != source[i])
        for mark in marks:
            if mark[i] >= 0:
                same &= (mark[:i] == mark[i]) | (mark[:i] < 0)
        apart = [np.abs(d[:i] - d[i]) > gap for d, gap in zip(days, (START_GAP, END_GAP), strict=True)]
        same &= ~(apart[0] & apart[1])
        held = np.bincount(group[:i][same], minlength=len(starts))
        home = np.flatnonzero((held == size[: len(starts)]) & (held > 0))
        if home.size:
            group[i] = home[0]
        else:
            group[i] = len(starts)
            starts.append(int(place[i]))
        size[group[i]] += 1
    return pd.Series(np.array(starts, np.int64)[group[first:]], index=records.index[first:])


def grouped(rows: DataFrame, tags: list[str], least: float = ALIKE, chunk: int = CHUNK) -> DataFrame:
    """rows (uid, source, core, richness, apply_start, apply_end, nth, tags...) with `group`, the uid of the record that each is merged into.

    Richest first, then by uid, a record joins the first group that has no record of its source and whose members are all the same announcement.
    A record can only join records that its name is linked with over like names, so blocks of linked names do not meet. A block is settled
    in rounds of `chunk` records in their order, of all blocks at once: a task holds the records of one round and, from the rounds before,
    the members of groups that lack a source still. A null or empty name is like no other; uid may not repeat.
    """
    names = stored(rows.select(F.coalesce("core", F.lit("")).alias("core")).distinct())
    links = stored(alike(candidate_pairs(names.filter("core <> ''"), least), least))
    need = ["source", "core", "apply_start", "apply_end", "nth", *tags]
    text = [F.col(c).cast("string").alias(c) for c in need if c != "core"]
    joined = rows.select("uid", "richness", F.coalesce("core", F.lit("")).alias("core"), *text).join(blocks(names, links), "core")
    # Records without a name are never the same as another.
    alone = joined.filter("core = ''").select("uid", F.col("uid").alias("group"))
    placed = placed_within(joined.filter("core <> ''"), "block", [F.col("richness").desc(), F.col("uid")], "place", "_size")
    placed = stored(placed.withColumn("_round", F.expr(f"place div {chunk}")))
    rounds = (placed.agg(F.max("_round")).first()[0] or 0) + 1
    near = stored(links.join(placed.select("core", "block").distinct(), "core"))
    result = "block string, place long, group long"
    # A block of one record needs no task of its own.
    done = placed.filter("_size = 1").select("block", "place", F.col("place").alias("group"))

    def run(records: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        group = settled(records, links, tags)
        return records.loc[group.index, ["block", "place"]].assign(group=group)

    columns = ["block", "place", *need]
    for k in range(rounds):
        now = placed.filter((F.col("_size") > 1) & (F.col("_round") == k)).select(*columns, F.lit(None).cast("long").alias("group"))
        own = near.select("block", "core", "other")
        if k:
            before = placed.filter("_size > 1").select(*columns).join(done, ["block", "place"])
            sources = placed.groupBy("block").agg(F.count_distinct("source").alias("_all"))
            open_ = before.groupBy("block", "group").agg(F.count("*").alias("_n")).join(sources, "block").filter("_n < _all").select("block", "group")
            now = now.unionByName(before.join(open_, ["block", "group"], "left_semi").select(*now.columns))
            own = own.join(placed.filter(F.col("_round") == k).select("block", "core").distinct(), ["block", "core"], "left_semi")
        done = stored(done.unionByName(now.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(run, result)))
    first = placed.select("block", F.col("place").alias("group"), F.col("uid").alias("_first"))
    out = placed.select("block", "place", "uid").join(done, ["block", "place"]).join(first, ["block", "group"])
    return out.select("uid", F.col("_first").alias("group")).unionByName(alone)


def merged(rows: DataFrame, groups: DataFrame, first: list[str], unions: list[str], flags: list[str]) -> DataFrame:
    """One row for each group: the richest record, with `first` fields taken from the next record that has them where it has none, `unions` (arrays)
    of all records in their order, `flags` set if any record has them set, links to all records, and also_on, the labels of the others.

    A stale record is fresh if another of its group is. rows: uid, source, source_label, url, richness, stale, stale_since and those fields.
    """
    order = F.struct((-F.col("richness")).alias("r"), "uid")
    each = rows.join(groups, "uid")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).alias("v")))), lambda x: x["v"])
    filled = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), order))
    link = F.struct(F.col("source_label").alias("label"), "url", "source")
    rest = [c for c in rows.columns if c not in [*first, *unions, *flags, "uid", "stale", "stale_since", "richness"]]
    out = each.groupBy("group").agg(
        *(F.min_by(F.col(c), order).alias(c) for c in rest),
        *(filled(c).alias(c) for c in first),
        *(F.array_distinct(F.flatten(in_order(c))).alias(c) for c in unions),
        *(F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in flags),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), link.alias("v")))), lambda x: x["v"])).alias("links"),
        F.bool_and(F.coalesce("stale", F.lit(False))).alias("stale"),
        F.min_by("stale_since", order).alias("stale_since"),
    )
    out = out.withColumn("stale_since", F.when(F.col("stale"), F.col("stale_since")).otherwise(""))
    return out.withColumn("also_on", F.transform(F.slice("links", 2, 1_000_000), lambda x: x["label"])).withColumnRenamed("group", "uid")


def fingerprint(rows: DataFrame) -> DataFrame:
    """(fingerprint): a hash of the rows, whatever their order: of their number and of the sums of eight parts of each row's SHA-256."""
    each = rows.select(F.sha2(F.concat_ws("|", *rows.columns), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    return each.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(F.coalesce(p, F.lit(0)).cast("string") for p in parts)), 256).alias("fingerprint"))
