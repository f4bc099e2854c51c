"""Ingest, folds and views against plain versions on small rows."""

import gzip
import json
import random
from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F
from tallyforge.functions import pricing
from tallyforge.operators import alerts, folds, ingest, order, report, views
from tallyforge.operators.attribution import ON_ROWS, first_match
from tallyforge.sources import inbox
from tallyforge.sources.scratch import drop_stored, scratch_dir, stored, tables_stored
from tallyforge.streaming import ledger as stream


def usage(uuid, ts, provider=None, session="s", i=1, cr=0, **more):
    return {"uuid": uuid, "ts": ts, "provider": provider, "account_email": "a@example.test", "session_id": session, "model": "m", "input_tokens": i, "output_tokens": 2, "cache_read_tokens": cr, **more}


def batches():
    copies = [usage("u1", 1000, cr=5), usage("u2", 2000, cr=5), usage("u3", 3000), usage("u4", 4000)]  # u2 has u1's content; u3 and u4 are too weak to tell
    scoped = [usage("v1", 1000, "beta", i=7), usage("v2", 9000, "beta", i=7), usage("v3", 9000, "beta", "t", i=7)]
    burst = [usage(f"w{i}", 50_000 + i, "beta", "fork", i=100 + i) for i in range(10)]
    odd = [usage("x1", 1, assumed=True), usage(None, 1), {**usage("x2", 1), "account_email": None}]
    return [{"host": "h", "generated_at": 5, "usage": copies + scoped}, {"host": "h", "generated_at": 6, "usage": burst + odd}, {"host": "h", "usage": [usage("again", 1000, cr=5)] + [usage(f"z{i}", 60_000 + i, "beta", "slow", i=i) for i in range(9)]}]


def write(root):
    (root / "n1").mkdir(parents=True)
    for k, b in enumerate(batches()):
        (root / "n1" / f"batch-{k}.json.gz").write_bytes(gzip.compress(json.dumps(b).encode()))


def test_stream_equals_batch_whatever_the_senders_ids(spark, tmp_path):
    write(tmp_path / "in")
    own = ingest.accepted(inbox.raw_turns(inbox.read_batches(spark, str(tmp_path / "in"))), ingest.Senders())
    want = sorted((r.uuid, r.i) for r in own.collect())
    # u1 for both copies and the one sent again, u3, u4, v1 for both of its session, v3, and nine slow ones.
    assert len(want) == 1 + 2 + 2 + 9
    out = str(tmp_path / "out")
    stream.write_turns(stream.deduplicated(inbox.stream_batches(spark, str(tmp_path / "in"), 1)), out, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.uuid, r.i) for r in spark.read.parquet(out).collect()) == want
    again = ingest.accepted(inbox.raw_turns(inbox.read_batches(spark, str(tmp_path / "in"))), ingest.Senders(), before=own.select("uuid"))
    assert again.isEmpty()


def test_changed_files_failures_and_counts(spark, tmp_path):
    root = tmp_path / "in"
    write(root)
    (root / "n1" / "batch-7.json.gz").write_bytes(gzip.compress(b"x" * 5000)[:40])
    (root / "n1" / "batch-8.json").write_text('{"host": "h", "usage": [{"uu')
    (root / "n1" / "batch-9.json").write_text("")
    (root / "skip").mkdir()
    (root / "skip" / "batch-1.json").write_text("{}")
    none = spark.createDataFrame([], "path string, size long, mtime long")
    listing = inbox.listing(spark, str(root), ["skip"])
    files = inbox.changed_files(listing, none)
    read = inbox.read_changed(spark, files)
    own = ingest.accepted(inbox.raw_turns(read), ingest.Senders())
    assert tuple(inbox.scan_counts(listing, files, read, own).first()) == (3, 0, 2, 14, 5)  # an empty file is none
    done = inbox.recorded(none, files, read)
    assert done.count() == 3
    files = inbox.changed_files(inbox.listing(spark, str(root), ["skip"]), done)
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["batch-7.json.gz", "batch-8.json"]
    assert inbox.read_changed(spark, files.limit(0)).isEmpty()


def test_folds_equal_sequential_ones(spark):
    pick = random.Random(2)
    rows, want = [], {}
    for n in range(300):
        r = {"provider": pick.choice(["", "beta", None]), "email": pick.choice("ab"), "account_id": pick.choice([None, f"i{n}"]), "usage_status": pick.choice([None, f"s{n}"]), "usage_status_at": pick.choice([None, pick.randrange(50)]), "at": pick.randrange(9)}
        rows.append((f"f{n // 50}", "n", r["at"], n, r["provider"], r["email"], r["account_id"], None, None, pick.randrange(9), None, r["usage_status"], r["usage_status_at"]))
        k = want.setdefault((r["provider"] or "alpha", r["email"]), {"id": None, "status": None, "most": 0, "seen": 0})
        at = r["usage_status_at"] or 0
        if r["usage_status"] is not None and at >= k["most"]:
            k["status"] = r["usage_status"]
        k["most"], k["id"], k["seen"] = max(k["most"], at), r["account_id"] or k["id"], max(k["seen"], r["at"])
    kind = "file_path string, node string, generated_at long, pos int, provider string, email string, account_id string, org_type string, display_name string, rate_limits_updated_at long, rate_limits string, usage_status string, usage_status_at long"
    got = ingest.folded_accounts(spark.createDataFrame(rows, kind), ingest.Senders())
    assert {(r.provider, r.email): {"id": r.account_id, "status": r.usage_status, "most": r.usage_status_at, "seen": r.last_seen} for r in got.collect()} == want


def test_nodes_and_sessions(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for k, b in enumerate([{"host": "h", "os_user": "a", "machine_id": "m", "generated_at": 9, "sessions": [{"session_id": "s", "cwd": "/a", "pid_alive": 1, "updated_at": 7, "surface": "other:my-cli"}]}, {"host": "h", "os_user": None, "generated_at": 5, "sessions": [{"session_id": "s", "pid_alive": None, "updated_at": 3}]}]):
        (tmp_path / "n" / f"batch-{k}.json").write_text(json.dumps(b))
    b = inbox.read_batches(spark, str(tmp_path))
    n = ingest.folded_nodes(b).first()
    assert (n.node, n.os_user, n.machine_id, n.last_report) == ("h", None, "m", 9)
    s = ingest.folded_sessions(inbox.session_observations(b), ingest.Senders()).first()
    assert (s.provider, s.cwd, s.pid_alive, s.updated_at, s.surface, s.reported_at) == ("alpha", "/a", None, 7, "terminal", 5)


def test_slow_drift_is_stored_once_it_adds_up(spark):
    d = spark.createDataFrame([("a", i, 100.0 + 0.4 * i) for i in range(10)] + [("b", 0, 1.0), ("b", 1, 1.0)], "k string, at int, v double")
    assert sorted((r.k, r.at) for r in folds.changes(d, ["k"], ["at"], "v", 1.0).collect()) == [("a", 0), ("a", 3), ("a", 6), ("a", 9), ("b", 0)]


def test_initial_value_anchors_what_was_spent(spark):
    d = spark.createDataFrame([("a", 5, 80), ("a", 6, 70), ("b", 1, 50), ("b", 7, 40)], "k string, at int, v int")
    got = {r.k: (r.spent, r.anchor, r.since) for r in folds.spent_since(d, ["k"], ["at"], "v", "at", F.lit(3), F.lit(100)).collect()}
    assert got == {"a": (30, 100, 3), "b": (10, 50, 3)}
    got = {r.k: (r.spent, r.anchor, r.since) for r in folds.spent_since(d, ["k"], ["at"], "v", "at", F.lit(3)).collect()}
    assert got == {"a": (10, 80, 5), "b": (10, 50, 3)}


def test_prices(spark):
    card = spark.createDataFrame([("m", "in", 4), ("m", "out", 8), ("free", "in", 0)], "model string, rate_key string, usd int")
    card = pricing.overlaid(card, spark.createDataFrame([("m", "out", None), ("m", "cr", 1), ("new", "in", 2)], "model string, rate_key string, usd int"))
    speeds = spark.createDataFrame([("m", "fast", 2)], "model string, speed string, multiplier int")
    long = spark.createDataFrame([("m", "in", 3)], "model string, rate_key string, lc_multiplier int")
    rows = [("m-20240101", "standard", 0), ("m", "fast", 1), ("m", "slow", 0), ("new", "standard", 1), ("free", "standard", 0), (None, "standard", 0)]
    groups = spark.createDataFrame([(*r, 10, 5, 2, 0, 0, 0) for r in rows], "model string, speed string, lc int, i long, o long, cr long, cw long, cw1h long, cwu long")
    got = {(r.model, r.speed, r.part): (None if r.rate is None else float(r.rate), r.reason) for r in pricing.priced(groups, card, speeds, long, F.lit(True), whole=True).collect()}
    assert got["m-20240101", "standard", "in"] == (4.0, None) and got["m-20240101", "standard", "out"] == (None, "no rate of this part")
    assert got["m", "fast", "in"] == (24.0, None) and got["m", "fast", "cr"] == (2.0, None) and got["m", "slow", "in"] == (None, "unknown speed")
    assert got["new", "standard", "in"] == (None, "no long-context rate") and got["free", "standard", "in"] == (0.0, None) and got[None, "standard", "in"] == (None, "unknown model")
    assert got["m", "slow", pricing.WHOLE] == (0.0, "unknown speed") and len(got) == 24
    assert float(spark.range(1).select(pricing.credits(F.lit(123_456_789))).first()[0]) == 12.3457


def test_many_rules_equal_few(spark):
    rows = [(i, f"o{i}", None, f"h{i}", None) for i in range(ON_ROWS + 50)] + [(9999, "glob", "/x/*", None, None)]
    kind = "rule_idx int, owner string, cwd_glob string, host string, provider string"
    s = spark.createDataFrame([("/x/1", f"h{i}", "p") for i in (0, ON_ROWS + 9, 10_000)] + [(None, None, None), ("/y", "h1", None)], "cwd string, host string, provider string")
    assert [r.owner for r in first_match(s, spark.createDataFrame(rows, kind)).orderBy(F.col("host").asc_nulls_first(), "cwd").collect()] == [None, "o0", "o1", "glob", f"o{ON_ROWS + 9}"]
    assert {r.owner for r in first_match(s, spark.createDataFrame([], kind)).collect()} == {None}


def test_positions_over_many_ranges(spark):
    d = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 5000).alias("v"))
    assert all(r.v == r.position for r in order.with_position(d, ["v"]).collect())
    assert order.with_position(d.limit(0), ["v"]).count() == 0
    names = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "n string")
    assert sorted((r.n or "", r.code) for r in order.coded(names, "n").collect()) == [("", 0), ("a", 1), ("b", 2), ("b", 2)]


def test_presets_and_csv(spark, tmp_path):
    assert report.presets("2024-01-20", "2024-03-05") == {"7 days": ("2024-02-28", "2024-03-05"), "30 days": ("2024-02-05", "2024-03-05"), "this month": ("2024-03-01", "2024-03-05"), "last month": ("2024-02-01", "2024-02-29"), "all": ("2024-01-20", "2024-03-05")}
    assert "last month" not in report.presets("2024-03-02", "2024-03-05") and report.days_between("2024-03-01", "2024-02-28") == 3
    kind = "owner string, microdollars decimal(38,6), tokens long, i long, o long, cw long, cr long, turns long, days long, unpriced long"
    from decimal import Decimal

    d = spark.createDataFrame([('a "b"', Decimal(5_000_000), 1, 2, 3, 4, 5, 6, 7, 8), ("c", Decimal(123_456_789), 0, 0, 0, 0, 0, 0, 0, 0)], kind)
    report.write_csv(d, ["owner"], str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text(encoding="utf-8").splitlines() == ['﻿"owner","credits","tokens","input","output","cache writes","cache reads","turns","days","unpriced tokens"', '"c",12.3457,0,0,0,0,0,0,0,0', '"a ""b""",0.5000,1,2,3,4,5,6,7,8']


def test_status_and_alerts(spark):
    forced = {"p:a": "suspended", "b": "paused"}
    rows = [("p", "a", "auth_error", 10, 5), ("q", "b", None, None, None), ("p", "c", "auth_error", 9_000_000, 100), ("p", "d", "unauthorized", 9_000_000, 7_300_000), ("p", "e", "auth_error", None, None), ("p", "f", "ok", 1, 1)]
    d = spark.createDataFrame(rows, "p string, e string, s string, at long, fetched long")
    out = d.select(views.account_status(d.p, d.e, d.s, d.at, d.fetched, forced), views.stale(d.fetched, 4_000_000)).collect()
    assert [tuple(r) for r in out] == [("suspended", True), ("paused", False), ("auth_error", True), ("ok", False), ("auth_error", False), ("ok", True)]
    b = spark.createDataFrame([("n", "p", x, "w", 9, 5, True, m) for x, m in (("a", 0), ("b", 10), ("c", 0))], "name string, provider string, account string, window string, value int, limit_value int, breached boolean, cooldown_minutes int")
    accounts = spark.createDataFrame([("p", "a", "ok", False), ("p", "b", "ok", False), ("p", "c", "suspended", False)], "provider string, account string, status string, stale boolean")
    log = spark.createDataFrame([(0, "n", "a"), (0, "n", "b")], "ts long, name string, account string")
    assert [r.account for r in alerts.to_send(b, accounts, 15 * 60_000, log).collect()] == ["b"]
    assert sorted(r.account for r in alerts.to_send(b, accounts, 30 * 60_000, log).collect()) == ["a", "b"]
    one = spark.range(1)
    assert tuple(one.select(views.severity(F.lit(75), F.lit(100)), views.severity(F.lit(None).cast("int"), F.lit(1)), views.freshness(4_000_000, F.lit(1), F.lit(True), F.lit(3_900_000)), views.freshness(4_000_000, F.lit(1), F.lit(False), F.lit(3_900_000)), views.freshness(4_000_000, F.lit(1), F.lit(True), F.lit(None).cast("long"))).first()) == ("warn", None, "sender stopped", "sync fails", "checker stopped")
    g = spark.createDataFrame([([(["day", "week"], 1, 2, 0)],)], "g array<struct<clears:array<string>,remaining:int,total:int,expires_at:long>>")
    assert tuple(g.select(views.grants(g.g, ["week", "month"])).first()[0][0]) == ("week", 1, 2, "1970-01-01T09:00")


def test_stored_tables_are_dropped(spark, tmp_path):
    before = tables_stored()
    a, b = stored(spark.range(3)), stored(spark.range(4))
    new = [p for p in tables_stored() if p not in before]
    drop_stored(keep=before + new[1:])
    assert len(new) == 2 and b.count() == 4 and tables_stored() == before + new[1:]
    from pathlib import Path

    assert not Path(new[0]).exists() and Path(new[1]).exists() and a is not None


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://there:7077"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(SimpleNamespace(conf=Conf()))


def test_credits_are_carried_forward(spark, tmp_path):
    """An absent key leaves the resets, an explicit null takes them away, and an older report never wins; balances keep each change once, of one sender only."""
    seen = [(10, {"balance": 5, "limit_resets": {"n": 1}}), (20, {"balance": 5.0}), (15, {"balance": 9, "limit_resets": {"n": 9}}), (30, {"balance": "none"}), (None, {"balance": 3}), (30, {"balance": 2, "limit_resets": None}), (30, {"balance": 8}), (40, None)]
    (tmp_path / "n").mkdir()
    for k, (at, credits) in enumerate(seen):
        account = {"email": "a", "provider": "beta"} | ({} if credits is None else {"credits": credits | ({"observed_at": at} if at else {})})
        (tmp_path / "n" / f"batch-{k}.json").write_text(json.dumps({"host": "h", "generated_at": k, "accounts": [account, {"email": "b", "credits": 5}, {"email": "c", "credits": {"observed_at": 7, "balance": 1}}]}))
    senders = ingest.Senders()
    for last, want in ((3, ('{"n":1}', 10, 30)), (4, ('{"n":1}', 10, 30)), (5, (None, None, 30)), (7, (None, None, 30))):
        b = inbox.read_batches(spark, str(tmp_path), pattern=f"batch-[0-{last}].json")
        observed = ingest.credit_observations(inbox.account_observations(b), senders)
        got = {r.email: (r.resets, r.resets_at, r.credits_at) for r in ingest.folded_credits(observed).collect()}
        if last == 3:
            assert got == {"a": ('{"n":1}', 10, 30), "c": (None, None, 7)}
        else:
            assert got["a"] == want
    series = ingest.balance_series(observed, senders).collect()
    assert sorted((r.email, r.at, r.balance) for r in series) == [("a", 10, 5.0), ("a", 15, 9.0), ("a", 20, 5.0), ("a", 30, 2.0)]


def test_batches_are_parsed_once_and_credits_cut_once(spark):
    rows = [("f1", '{"host":"h","generated_at":1,"accounts":[{"email":"a","credits":{"observed_at":5,"balance":1,"limit_resets":{"n":1}}},null,{"email":"a","credits":{"observed_at":4,"limit_resets":null}}]}'), ("f2", '{"host":"h","accounts":[]}'), ("f3", '{"host":"h"}')]
    text = spark.createDataFrame(rows, "file_path string, body string").repartition(2)
    batches = text.select("file_path", F.from_json("body", inbox.BATCH).alias("b")).select("file_path", "b.*", F.col("b.host").alias("node"))
    seen = inbox.account_observations(batches)
    assert seen.select("file_path", "pos", "email")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted((r.file_path, r.pos, r.email) for r in seen.collect()) == [("f1", 0, "a"), ("f1", 2, "a")]
    before = len(tables_stored())
    out = ingest.folded_credits(ingest.credit_observations(seen, ingest.Senders())).collect()
    assert [(r.credits_at, r.resets, r.resets_at) for r in out] == [(5, '{"n":1}', 5)] and len(tables_stored()) - before == 2
