"""From batch files to the ledger: turns by content identity, without replays and what a seed has counted; folds of nodes, accounts and sessions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import content_id, number, session_scoped_id, surface, written_for_an_hour
from ..sources.scratch import stored
from .folds import changes, guarded_latest, last_records, last_values
from .ledger import one_per_key, provable, without_bursts

#: The order in which records arrive.
ARRIVAL = ["file_path", "pos"]


@dataclass(frozen=True)
class Senders:
    """What is known of the tools that send batches."""

    #: Of records that name none.
    default: str = "alpha"
    #: Copies of its turns stay within a session; its cache writes have no lifetimes; it replays whole histories in bursts.
    scoped: str = "beta"
    #: So many turns of one session in one second of a batch are a replay.
    burst: int = 10
    #: Parts of unknown surface names that tell the surface.
    surfaces: dict[str, str] = field(default_factory=lambda: {"cli": "terminal", "tui": "terminal", "code": "editor", "desktop": "desktop"})


def provider_of(x: Column, senders: Senders) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(senders.default))


def identified(raw: DataFrame, senders: Senders) -> DataFrame:
    """raw_turns as turns: numbers from whatever was sent, uuid the identity by content (null if the sender gave none)."""
    p = provider_of(F.col("provider"), senders)
    i, o, cr = (number(F.col(f"{c}_tokens")) for c in ("input", "output", "cache_read"))
    cw = number(F.col("cache_creation_tokens"))
    scoped = p == senders.scoped
    told = lambda c: F.when(F.col(c).try_cast("double").isNotNull(), number(F.col(c)))
    key = F.when(scoped, session_scoped_id(senders.scoped, F.col("session_id"), F.col("model"), i, o, cr)).otherwise(content_id(senders.default, F.col("uuid"), F.col("model"), i, o, cw, cr))
    return raw.select(
        *ARRIVAL,
        F.when(F.nullif("uuid", F.lit("")).isNotNull(), key).alias("uuid"),
        F.col("ts"),
        p.alias("provider"),
        F.nullif("account_email", F.lit("")).alias("account"),
        F.col("node").alias("host"),
        F.col("session_id"),
        F.col("cwd"),
        F.col("project"),
        F.col("model"),
        surface(F.col("surface"), senders.surfaces).alias("surface"),
        F.col("assumed"),
        i.alias("i"),
        o.alias("o"),
        cw.alias("cw"),
        cr.alias("cr"),
        written_for_an_hour(told("cache_creation_1h_tokens"), told("cache_creation_5m_tokens"), cw, scoped).cast("bigint").alias("cw1h"),
        F.col("speed"),
        F.col("effort"),
    )


def proven(turns: DataFrame, seed_until: int | None = None) -> DataFrame:
    """Identified turns that may count, copies too: later than the seed, with an id and an account that is not assumed."""
    turns = turns.filter(F.coalesce("ts", F.lit(0)) > seed_until) if seed_until else turns
    return provable(turns.withColumnRenamed("account", "account_email")).withColumnRenamed("account_email", "account").drop("assumed")


def candidates(raw: DataFrame, senders: Senders, seed_until: int | None = None) -> DataFrame:
    """The proven turns of raw that are no replay; replays are sought in each batch, before all else."""
    own = without_bursts(identified(raw, senders), senders.burst, F.col("provider") == senders.scoped, ["file_path", "session_id"])
    return proven(own, seed_until)


def not_replayed(usage: Column, senders: Senders) -> Column:
    """array<boolean> for a batch's usage records: false for those of a burst. The same as in `candidates`, of one batch at a time, for streams."""

    @F.pandas_udf("array<boolean>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for providers, sessions, times in batches:
            out = []
            for p, s, t in zip(providers, sessions, times, strict=True):
                keys = [(b, 0 if c is None or pd.isna(c) else int(c) // 1000) if a == senders.scoped else None for a, b, c in zip(p, s, t, strict=True)] if p is not None else []
                n = Counter(k for k in keys if k)
                out.append([k is None or n[k] < senders.burst for k in keys])
            yield pd.Series(out)

    return run(usage["provider"], usage["session_id"], usage["ts"])


def accepted(raw: DataFrame, senders: Senders, seed_until: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """Each turn once, its first arrival; none whose uuid is in `before`, the turns accepted so far."""
    turns = one_per_key(candidates(raw, senders, seed_until), "uuid", [F.col(c) for c in ARRIVAL])
    return turns if before is None else turns.join(before.select("uuid"), "uuid", "left_anti")


def folded_nodes(batches: DataFrame) -> DataFrame:
    """One row per node: what it said last, the machine it last named, and its latest report."""
    rows = batches.filter(F.col("_corrupt").isNull()).withColumnRenamed("generated_at", "last_report").withColumn("diagnostics", F.to_json("diagnostics"))
    rows = rows.withColumn("diagnostics", F.when(~F.col("diagnostics").isin("null", "{}", "[]", '""'), F.col("diagnostics")))
    return last_values(rows, ["node"], ["file_path"], ["os_user", "sender_root", "fqdn", "ip", "home"], ["machine_id", "diagnostics"], ["last_report"])


def folded_accounts(observations: DataFrame, senders: Senders) -> DataFrame:
    """One row per (provider, email): names last known, limits and status by the guard of their own times, last seen."""
    rows = observations.withColumn("provider", provider_of(F.col("provider"), senders)).withColumnRenamed("generated_at", "last_seen")
    keys = ["provider", "email"]
    for value, at in (("rate_limits", "rate_limits_updated_at"), ("usage_status", "usage_status_at")):
        rows = rows.withColumn(at, F.coalesce(at, F.lit(0)))
    names = [c for c in ("account_id", "org_type", "rate_limit_tier", "display_name", "org_name") if c in rows.columns]
    # Read three times, and twice more to find ranges: batches are parsed once.
    rows = stored(rows.select(*keys, *ARRIVAL, *names, "last_seen", "rate_limits", "rate_limits_updated_at", "usage_status", "usage_status_at"))
    out = last_values(rows, keys, ARRIVAL, [], names, ["last_seen"])
    for value, at in (("rate_limits", "rate_limits_updated_at"), ("usage_status", "usage_status_at")):
        out = out.join(guarded_latest(rows.select(*keys, *ARRIVAL, value, at), keys, ARRIVAL, value, at), keys)
    return out


def credit_observations(observations: DataFrame, senders: Senders) -> DataFrame:
    """(provider, email, arrival, at, credits as JSON text, balance, told, resets) of the observations whose credits are an object.

    told: whether they have limit_resets at all. An absent key, which older senders leave out, and an explicit null, which takes the resets away, differ.
    """
    own = observations.withColumn("provider", provider_of(F.col("provider"), senders)).filter(F.schema_of_variant("credits").startswith("OBJECT"))
    of = lambda path, kind: F.try_variant_get("credits", path, kind)
    numeric = F.schema_of_variant(of("$.balance", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    resets = of("$.limit_resets", "variant")
    return own.select(
        "provider", "email", *ARRIVAL, F.coalesce(of("$.observed_at", "bigint"), F.lit(0)).alias("at"), F.to_json("credits").alias("credits"),
        F.when(numeric, of("$.balance", "double")).alias("balance"), resets.isNotNull().alias("told"), F.when(~F.is_variant_null(resets), F.to_json(resets)).alias("resets"),
    )


def folded_credits(observed: DataFrame) -> DataFrame:
    """One row per (provider, email) of credit_observations: the credits observed last, with resets carried forward from the last that told them."""
    keys = ["provider", "email"]
    both = {"_last": (F.col("credits").isNotNull(), F.col("credits")), "_told": (F.col("told"), F.col("resets"))}
    out = last_records(observed, keys, ARRIVAL, "at", both).withColumn("resets", F.col("_told._what"))
    return out.select(*keys, F.col("_last._what").alias("credits"), F.col("_most").alias("credits_at"), "resets", F.when(F.col("resets").isNotNull(), F.col("_told._stamp")).alias("resets_at"))


def balance_series(observed: DataFrame, senders: Senders, least: float = 1e-6) -> DataFrame:
    """(provider, email, at, balance): the balances of senders that have one, in the order of their times, each change once; of one time the first to arrive."""
    own = observed.filter((F.col("provider") == senders.scoped) & F.col("balance").isNotNull() & (F.col("at") != 0))
    first = own.groupBy("provider", "email", "at").agg(F.min_by("balance", F.struct(*ARRIVAL)).alias("balance"))
    return changes(first, ["provider", "email"], ["at"], "balance", least)


def folded_sessions(observations: DataFrame, senders: Senders) -> DataFrame:
    """One row per (provider, session_id): state as last told, what is known of it, and its latest use."""
    rows = observations.withColumn("provider", provider_of(F.col("provider"), senders)).withColumn("surface", surface(F.col("surface"), senders.surfaces))
    rows = rows.withColumnRenamed("node", "host").withColumnRenamed("account_email", "account").withColumnRenamed("generated_at", "reported_at")
    known = ["account", "cwd", "project", "version", "kind", "entrypoint", "surface", "started_at"]
    return last_values(rows, ["provider", "session_id"], ARRIVAL, ["host", "status", "pid", "pid_alive", "reported_at"], known, ["updated_at"])


def seeded(totals: DataFrame, seed: DataFrame) -> DataFrame:
    """Session totals on top of those of an older snapshot, whose turns must have been left out of totals (`seed_until`).

    Both: the columns of session_totals. Sums add up; of what was seen last the later one counts, of sets the union.
    """
    keys, sums = ["provider", "session_id"], ["turns", "i", "o", "cw", "cr"]
    both = seed.withColumn("_late", F.lit(0)).unionByName(totals.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    last = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_late"))) for c in totals.columns if c not in [*keys, *sums, "first_ts", "last_ts", "models", "surfaces"]}
    sets = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) for c in ("models", "surfaces") if c in totals.columns}
    aggs = {c: F.sum(c) for c in sums} | {"first_ts": F.min("first_ts"), "last_ts": F.max("last_ts")} | last | sets
    return both.groupBy(*keys).agg(*(aggs[c].alias(c) for c in totals.columns if c not in keys))


def inserted(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows, and those of new whose key is not there; what is there stays as it is."""
    return rows.unionByName(new.join(rows.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replaced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with a key, the last by `order`, which must be total."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def widened(rows: DataFrame, schema) -> DataFrame:
    """rows with the columns of a newer schema that they lack, as nulls; nothing is taken away, and doing so again changes nothing."""
    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in rows.columns))


def retracted(totals: DataFrame, gone: DataFrame) -> DataFrame:
    """Session totals without turns that were taken back, never below 0."""
    sums = ["turns", "i", "o", "cw", "cr"]
    key = F.coalesce(F.nullif("session_id", F.lit("")), F.concat(F.lit("_"), "uuid"))
    less = gone.groupBy("provider", key.alias("session_id")).agg(F.count("*").alias("_turns"), *(F.sum(F.coalesce(c, F.lit(0))).alias(f"_{c}") for c in sums[1:]))
    joined = totals.join(less, ["provider", "session_id"], "left")
    return joined.select(*(F.greatest(F.lit(0), F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in sums else F.col(c) for c in totals.columns))
