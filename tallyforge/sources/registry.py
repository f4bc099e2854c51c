"""The registry of sources: what is asked to be added is checked, and put in by its key or its address."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import blocks
from .scratch import stored

#: What a request may say and must say, the longest texts, the most pages, and the names of the machine itself.
ALLOWED = ("key", "label", "org", "list_url", "detail_url", "page_param", "pages", "program")
REQUIRED, LONGEST, PAGES, OWN_NAMES = ("label", "list_url"), {"label": 80, "org": 80, "program": 120}, 20, ("localhost", "localhost.localdomain")
#: The networks, by their first bits, that are no public address: this host, private, shared, loopback, link-local, reserved.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "240.0.0.0/4")


def host_of(url: Column) -> Column:
    """The host of an http or https address, lower-cased, without user and port; empty for others."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def _number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    return sum((F.get(parts, F.lit(k)).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0).cast("bigint"))


def is_internal(host: Column) -> Column:
    """Whether a host names the machine itself or a private network, by its name or its address; names are not resolved."""
    numeric = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    out = host.isin(*OWN_NAMES) | host.endswith(".internal") | host.rlike(r"^\[(::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*)\]$")
    for network in PRIVATE:
        first, bits = network.split("/")
        octets = [int(x) for x in first.split(".")]
        low = sum(x << (24 - 8 * k) for k, x in enumerate(octets))
        out = out | F.coalesce(numeric & _number(host).between(low, low + (1 << (32 - int(bits))) - 1), F.lit(False))
    return out


def checked(requests: DataFrame, text_col: str = "text") -> DataFrame:
    """requests with `problem`, the first reason why a request (a JSON object) is not taken, else null, and what is taken of it: key, label, org,
    list_url, detail_url, page_param, pages, program."""
    raw = requests.withColumn("_c", F.from_json(text_col, "map<string,string>"))
    said = lambda k: F.nullif(F.trim(F.col("_c")[k]), F.lit(""))
    unknown = F.array_sort(F.array_except(F.map_keys("_c"), F.array(*map(F.lit, ALLOWED))))
    site, detail = host_of(said("list_url")), host_of(said("detail_url"))
    problem = F.coalesce(
        F.when(F.col("_c").isNull(), "no object"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))),
        *(F.when(said(k).isNull(), F.lit(f"missing: {k}")) for k in REQUIRED),
        F.when(site == "", "no web address"), F.when(is_internal(site), "internal address"),
        F.when(~said("page_param").rlike("^[A-Za-z0-9_]{1,40}$"), "odd page parameter"),
        F.when(said("pages").isNotNull() & said("pages").try_cast("int").isNull(), "odd number of pages"),
        F.when(detail == "", "no web address of details"), F.when(is_internal(detail), "internal address of details"), F.when(~said("detail_url").contains("{id}"), "no {id} in the address of details"),
    )
    key = F.substring(F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.coalesce(said("key"), site)), F.lit("www."), F.lit("")), "[^a-z0-9_]+", "_"), "^_+|_+$", ""), 1, 32)
    pages = F.greatest(F.lit(1), F.least(F.coalesce(said("pages").try_cast("int"), F.lit(1)), F.lit(PAGES)))
    taken = {"key": F.coalesce(F.nullif(key, F.lit("")), F.lit("site")), "pages": pages} | {k: F.substring(said(k), 1, LONGEST[k]) if k in LONGEST else said(k) for k in ALLOWED if k not in ("key", "pages")}
    fine = raw.withColumn("problem", problem)
    return fine.select(*requests.columns, "problem", *(F.when(F.col("problem").isNull(), taken[k]).alias(k) for k in ALLOWED))


def upserted(rows: DataFrame, new: DataFrame, keys: tuple[str, str] = ("key", "list_url"), order: str = "n") -> DataFrame:
    """rows (place, keys, ...) after the requests of new (order, keys, ...) one after the other: a request changes the first row with one of its two
    keys, in what it says, and is a row of its own behind all others where there is none.

    A changed row is known by its new keys from then on. Rows and requests that are not linked over keys do not meet, so each block of linked ones
    is gone through by itself: a block is as large as the requests on one source, which people write.
    """
    fields = [c for c in rows.columns if c != "place"]
    last = F.lit(rows.agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0])
    old = rows.select(F.col("place").cast("long").alias("place"), F.lit(False).alias("_new"), *fields)
    asked = new.select((last + 1 + F.col(order)).cast("long").alias("place"), F.lit(True).alias("_new"), *(F.col(f) if f in new.columns else F.lit(None).cast(rows.schema[f].dataType).alias(f) for f in fields))
    every = stored(old.unionByName(asked))
    name = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.concat(F.lit("-"), F.col("place").cast("string")))) for k in keys]
    pairs = stored(every.select(name[0].alias("core"), name[1].alias("other")).distinct())
    names = pairs.select("core").union(pairs.select("other")).distinct()
    block = blocks(stored(names), pairs).select(F.col("core").alias("_core"), F.col("block").alias("_block"))
    placed = every.withColumn("_core", name[0]).join(block, "_core").drop("_core")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: list[dict] = []
        for r in pdf.sort_values("place").astype(object).where(lambda x: x.notna(), None).to_dict("records"):
            same = next((h for h in held if any(r[k] is not None and h[k] == r[k] for k in keys)), None) if r["_new"] else None
            if same is None:
                held.append(r)
                held.sort(key=lambda h: h["place"])
            else:
                same.update({f: r[f] for f in fields if r[f] is not None})
        return pd.DataFrame([[h[c] for c in ("place", *fields)] for h in held], columns=["place", *fields])

    kinds = dict(every.dtypes)
    return placed.groupBy("_block").applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("place", *fields)))
