"""Operators against plain versions on small rows."""

import fnmatch
import gzip
import json
import random

from pyspark.sql import functions as F
from tallyforge.functions import identity as I
from tallyforge.functions import text as X
from tallyforge.operators import alerts, board, folds, merge, views
from tallyforge.operators.attribution import owners
from tallyforge.operators.ledger import one_per_key, provable
from tallyforge.plans import ingest as ingest_plan
from tallyforge.plans import views as views_plan
from tallyforge.sources.inbox import account_observations, changed_files, raw_turns, read_batches, session_observations, stream_batches
from tallyforge.streaming import ledger as stream


def batch(n, first, host="h1"):
    usage = [{"uuid": f"u{i}", "ts": 1_700_000_000_000 + i, "account_email": "a@example.test", "input_tokens": i, "assumed": i % 4 == 3} for i in range(first, first + n)]
    return {"host": host, "generated_at": 5, "usage": usage, "accounts": [{"email": "a@example.test", "rate_limits": {"short": {"utilization": 0.5}}}], "sessions": [{"session_id": "s", "pid_alive": None}]}


def write_inbox(root):
    for node, name, content in (("n1", "batch-1.json", json.dumps(batch(5, 0))), ("n1", "batch-3.json", '{"host": "h1", "usage": [{"uu'), ("n1", "batch-4.json.gz.building", "x")):
        (root / node).mkdir(exist_ok=True)
        (root / node / name).write_text(content)
    (root / "n2").mkdir()
    (root / "n2" / "batch-2.json.gz").write_bytes(gzip.compress(json.dumps(batch(5, 3, None)).encode()))


def test_batches_are_read(spark, tmp_path):
    write_inbox(tmp_path)
    b = read_batches(spark, str(tmp_path)).cache()
    assert b.count() == 3 and b.filter("_corrupt is not null").count() == 1
    assert {r.node for r in b.collect()} == {"h1", "n1", "n2"} or {r.node for r in b.collect()} == {"h1", "n2"}
    turns = raw_turns(b)
    assert turns.count() == 10 and provable(turns).count() == 7
    once = one_per_key(provable(turns), "uuid", [F.col("file_path"), F.col("pos")])
    assert sorted(r.uuid for r in once.collect()) == ["u0", "u1", "u2", "u4", "u5", "u6"]
    assert account_observations(b).first().rate_limits["short"].utilization == 0.5 and session_observations(b).first().pid_alive is None
    assert read_batches(spark, str(tmp_path), ["n2"]).count() == 2


def test_changed_files(spark):
    kind = "path string, size long, mtime long"
    listing = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 0, 1), ("d", 3, 1)], kind)
    assert sorted(r.path for r in changed_files(listing, spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], kind)).collect()) == ["b", "d"]


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write_inbox(inbox)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: stream.write_turns(stream.deduplicated(stream_batches(spark, str(inbox), 1)), out, check).awaitTermination()
    run()
    assert sorted(r.uuid for r in spark.read.parquet(out).collect()) == ["u0", "u1", "u2", "u4", "u5", "u6"]
    (inbox / "n1" / "batch-9.json").write_text(json.dumps(batch(4, 5)))
    run()
    assert sorted(r.uuid for r in spark.read.parquet(out).collect()) == ["u0", "u1", "u2", "u4", "u5", "u6", "u8"]


def test_guarded_fold_equals_the_sequential_one(spark):
    pick = random.Random(4)
    rows = [(k, i, pick.choice([None, pick.randrange(100)]), pick.randrange(10)) for k in range(40) for i in range(pick.randint(1, 8))]
    want = {}
    for k, _, value, at in rows:
        held, most = want.get(k, (None, None))
        want[k] = (value if value is not None and (most is None or at >= most) else held, at if most is None else max(most, at))
    d = spark.createDataFrame(rows, "k int, pos int, value int, at int")
    assert {r.k: (r.value, r.at) for r in folds.guarded_latest(d, ["k"], ["pos"], "value", "at").collect()} == want


def test_spent_since(spark):
    d = spark.createDataFrame([("a", 1, 100), ("a", 2, 80), ("a", 3, 120), ("a", 4, 90), ("b", 5, 7)], "k string, at int, v int")
    out = {r.k: (r.spent, r.anchor) for r in folds.spent_since(d, ["k"], ["at"], "v", "at", F.lit(2)).collect()}
    assert out == {"a": (50, 100), "b": (0, 7)}
    assert [r.v for r in folds.changes(d.union(spark.createDataFrame([("a", 5, 90)], d.schema)), ["k"], ["at"], "v").orderBy("k", "at").collect()] == [100, 80, 120, 90, 7]


def test_pins_then_rules_then_launch_path(spark):
    s = spark.createDataFrame([("1", "/a/x", None, "p", None), ("2", "/b", "h", "p", "/a/y"), ("3", "/c", "h2", "q", None), ("4", "/a/z\nq", None, None, None), ("5", None, None, None, None)], "session_id string, cwd string, host string, provider string, launch_cwd string")
    rules = spark.createDataFrame([(0, "none", None, None, None), (1, "A", "/a/*", None, None), (2, "H", None, "h2", "q")], "rule_idx int, owner string, cwd_glob string, host string, provider string")
    pins = spark.createDataFrame([("1", "PIN")], "session_id string, owner string")
    assert {r.session_id: r.owner for r in owners(s, rules, pins).collect()} == {"1": "PIN", "2": "A", "3": "H", "4": "A", "5": None}


def test_globs_are_those_of_shells(spark):
    pick = random.Random(12)
    globs = ["[!]", "[]", "[", "a[", "[a-c]*", "[!a-c]", "[]a]", "[!]a]", "[&&b]", "[^a]", "[a^]", "[[]", "[\\\\]", "*.b", "?", "", "a+b", "(a|b)", "{a}", "a\n?"]
    globs += ["".join(pick.choice(["*", "?", "[ab]", "[!ab]", "[a-c", "]", "a", "b", ".", "-"]) for _ in range(pick.randrange(1, 6))) for _ in range(60)]
    names = ["", "a", "b", "c", "-", "]", "[", "!", "^", "&", "ab", "a.b", "a+b", "(a|b)", "{a}", "a\nb", "a\n", "\\\\", "abc", "b]", "[]", "[!]", "a["]
    names += ["".join(pick.choice("abc.-][") for _ in range(pick.randrange(1, 5))) for _ in range(60)]
    d = spark.createDataFrame([(g, n) for g in globs for n in names], "g string, n string")
    wrong = [(r.g, r.n) for r in d.withColumn("fits", F.regexp_like("n", I.glob(F.col("g")))).collect() if r.fits != fnmatch.fnmatchcase(r.n, r.g)]
    assert wrong == []


def test_cooldown(spark):
    rows = [("t", "a", m * 60_000, c) for m, c in ((0, 10), (5, 10), (10, 10), (19, 10), (20, 10))] + [("u", "a", 0, 0), ("u", "a", 29 * 60_000, 0), ("u", "a", 30 * 60_000, 0)]
    d = spark.createDataFrame(rows, "name string, account string, ts long, cooldown_minutes int")
    assert sorted((r.name, r.ts // 60_000) for r in alerts.with_cooldown(d).collect()) == [("t", 0), ("t", 10), ("t", 20), ("u", 0), ("u", 30)]


def test_cooldown_of_a_stream(spark, tmp_path):
    d = spark.createDataFrame([("t", "a", m * 60_000, 10) for m in (0, 5, 12)], "name string, account string, ts long, cooldown_minutes int")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.cooled(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.ts // 60_000 for r in spark.table("sent").collect()) == [0, 12]


def test_scalar_functions(spark):
    d = spark.createDataFrame([("12.9", "other:my-cli_x"), ("x", "web"), (None, "other:zzz")], "n string, s string")
    got = d.select(I.number(d.n), I.surface(d.s, {"cli": "terminal"})).collect()
    assert [tuple(r) for r in got] == [(12, "terminal"), (0, "web"), (0, "other:zzz")]
    one = spark.range(1)
    assert one.select(X.html_to_text(F.lit("<style>a</style><p>x &amp;&nbsp;y</p><td>1</td><td>2</td><br/>z<!-- c -->"))).first()[0] == "x & y\n1 2 \nz".replace(" \n", "\n")
    assert one.select(X.parsed_date(F.lit("until 24/2/30")), X.parsed_range(F.lit("2024.3.1 ~ 4.15(Mon)"))).first()[1] == ("2024-03-01", "2024-04-15")
    assert one.select(board.distinct_lines(F.array(F.lit("a b"), F.lit("AB c"), F.lit("a-b c"), F.lit("z")))).first()[0] == ["a b", "AB c", "z"]


def test_merge_is_greedy_and_complete(spark):
    rows = [(1, "x", "gpu support round 1", 3), (2, "y", "gpu support round 1.", 2), (3, "x", "gpu support round 1", 1), (4, "z", "other", 9)]
    d = spark.createDataFrame([(*r, None, None, None) for r in rows], "uid int, source string, core string, richness int, apply_start string, apply_end string, nth string")
    assert {r.uid: r.group for r in merge.grouped(d, []).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_state_of_old_alerts_goes(spark, tmp_path):
    """Three micro-batches: the state of the first alert times out, and later alerts are sent as before."""
    kind = "name string, account string, ts long, cooldown_minutes int"
    hour = 3_600_000
    for n, rows in enumerate([[("t", "a", 0, 10), ("t", "a", 60_000, 10)], [("t", "b", 5 * hour, 10)], [("t", "b", 6 * hour, 10)], [("t", "a", 9 * hour, 10), ("t", "a", 9 * hour + 1, 10)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = stream.cooled(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), kept_minutes=30)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert left <= 2 and (n != 2 or left == 1)
    assert sorted((r.account, r.ts) for r in spark.read.schema(kind).parquet(str(tmp_path / "out")).collect()) == [("a", 0), ("a", 9 * hour), ("b", 5 * hour), ("b", 6 * hour)]


def test_percent_is_rounded_once_and_turns_without_tokens_count(spark, tmp_path):
    money = spark.createDataFrame([("w", "a", 4_999_996), ("w", "a", 100_000_000_000 - 4_999_996)], "window string, owner string, microdollars bigint")
    got = views._with_pct(money.withColumn("microdollars", F.col("microdollars").cast("decimal(38,6)"))).collect()
    assert sorted(r.pct for r in got) == [0, 10_000]
    rows = [(140, "2024-01-28 10:00:00", 7, "purchase", 0.0, '{"k": 0}'), (280, "2024-01-29 10:00:00", 7, "purchase", 1.5, '{"k": 3}')]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.turns for r in views_plan.QUERIES["credit_groups"](spark, str(tmp_path)).collect()] == [2]


def test_account_observations_are_parsed_once(spark, sf_dir):
    """What is folded several times is read from the stored observations, not from the batches again."""
    read = ingest_plan.folded_accounts(spark, sf_dir).inputFiles()
    assert read and not [f for f in read if "orders.parquet" in f]
