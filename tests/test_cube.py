"""The cube and the totals kept up run by run, against all turns summed up at once."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from tallyforge.operators.ledger import session_totals
from tallyforge.operators.rollup import day_cube
from tallyforge.sources import inbox, versions
from tallyforge.sources.versions import advance, current, heads, superseded
from tallyforge.streaming import cube
from tallyforge.streaming import ledger as stream

rule = lambda: (1000, F.col("provider") == "beta")
TURN = "uuid string, ts long, provider string, account string, host string, session_id string, cwd string, model string, speed string, effort string, i long, o long, cw long, cr long, cw1h long"
DAY = 86_400_000


def turns(pick, first, n, days=6):
    return [
        (f"u{k}", 1_700_000_000_000 + pick.randrange(days * DAY), pick.choice(["alpha", "beta"]), pick.choice("ab"), "h", pick.choice(["s1", "s2", "s3", "", None]), pick.choice(["/a", "/b"]), pick.choice(["m", "n", ""]), pick.choice([None, "", "fast"]), None, pick.randrange(900), 1, 2, pick.randrange(900), pick.choice([None, 1]))
        for k in range(first, first + n)
    ]


def cube_of(spark, rows):
    return sorted(map(str, day_cube(spark.createDataFrame(rows, TURN), *rule()).select(*cube.KEYS, *cube.MEASURES).collect()))


def held_cube(spark, root):
    return sorted(map(str, current(spark, root, "cube", cube.SCHEMAS["cube"]).select(*cube.KEYS, *cube.MEASURES).collect()))


def test_runs_replays_and_crashes_equal_a_full_sum(spark, tmp_path, monkeypatch):
    pick, root = random.Random(4), str(tmp_path / "root")
    batches = [turns(pick, 100 * k, 60) for k in range(4)]
    gone = [(*x[:1], x[1] + 30 * DAY, *x[2:]) for x in batches[1]]  # as if read a month late, each day of it to be emptied
    step = lambda rows, taken=None: cube.updates(spark.createDataFrame(rows, TURN), *rule(), spark.createDataFrame(taken, TURN) if taken else None)
    assert advance(spark, root, 1, cube.SCHEMAS, step(batches[0]))
    assert not advance(spark, root, 1, cube.SCHEMAS, step(batches[3]))
    assert held_cube(spark, root) == cube_of(spark, batches[0])
    whole = versions.commit

    def breaks(*_):
        raise OSError("gone")

    monkeypatch.setattr(versions, "commit", breaks)
    with pytest.raises(OSError, match="gone"):
        advance(spark, root, 2, cube.SCHEMAS, step(batches[3]))
    assert held_cube(spark, root) == cube_of(spark, batches[0])
    monkeypatch.setattr(versions, "commit", whole)
    assert advance(spark, root, 2, cube.SCHEMAS, {"cube": step(batches[1] + gone)["cube"], "sessions": step(batches[1])["sessions"]})
    assert held_cube(spark, root) == cube_of(spark, batches[0] + batches[1] + gone)
    days = heads(spark, root, "cube").count()
    assert advance(spark, root, 3, cube.SCHEMAS, step(batches[2], gone))
    assert held_cube(spark, root) == cube_of(spark, sum(batches[:3], [])) and heads(spark, root, "cube").count() < days
    old = {(r.part, r.version) for r in superseded(spark, root, "cube", 3).collect()}
    live = {(r.part, r.version) for r in heads(spark, root, "cube").collect()}
    assert old and not old & live
    want = session_totals(spark.createDataFrame(sum(batches[:3], []), TURN))
    columns = ["provider", "session_id", *cube.SUMS, "first_ts", "last_ts", "models"]
    got = current(spark, root, "sessions", cube.SCHEMAS["sessions"])
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    # last is one row's, while session_totals looks for each value's last one: they agree where none is null.
    assert {(r.session_id, r.provider): r["last"].cwd for r in got.collect()} == {(r.session_id, r.provider): r.cwd for r in want.collect()}


def test_a_run_reads_and_writes_changed_parts_only(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = turns(random.Random(1), 0, 200)
    advance(spark, root, 1, cube.SCHEMAS, cube.updates(spark.createDataFrame(rows, TURN), *rule()))
    one = [("x", 1_700_000_000_000, "alpha", "a", "h", "s1", "/a", "m", None, None, 1, 1, 1, 1, None)]
    advance(spark, root, 2, cube.SCHEMAS, cube.updates(spark.createDataFrame(one, TURN), *rule()))
    assert len([x for x in os.listdir(f"{root}/cube/version=2") if x.startswith("part=")]) == 1 < len([x for x in os.listdir(f"{root}/cube/version=1") if x.startswith("part=")])
    assert held_cube(spark, root) == cube_of(spark, rows + one)


def batch(n, first):
    return {"host": "h", "generated_at": 5, "usage": [{"uuid": f"u{i}", "ts": 1_700_000_000_000 + i * DAY // 7, "account_email": "a@example.test", "session_id": f"s{i % 3}", "model": "m", "input_tokens": i, "output_tokens": 1} for i in range(first, first + n)]}


def put(root, name, content):
    (root / "n1").mkdir(parents=True, exist_ok=True)
    (root / "n1" / name).write_bytes(content if isinstance(content, bytes) else gzip.compress(json.dumps(content).encode()))


def test_an_inbox_in_runs(spark, tmp_path):
    """Broken files are counted and tried again, rewritten ones are read again, and whatever comes twice counts once."""
    box, root = tmp_path / "in", str(tmp_path / "root")
    for k in range(5):
        put(box, f"batch-{k}.json.gz", batch(10, 7 * k))
    put(box, "batch-5.json.gz", gzip.compress(json.dumps(batch(9, 90)).encode())[:-20])
    put(box, "batch-6.json.gz", b"")
    read = lambda most: cube.ingest_inbox(spark, str(box), root, *rule(), most=most)
    assert read(2) == {"batches": 5, "skipped": 0, "failed": 1, "usage_rows": 38, "total_batches": 6}
    assert read(100) == {"batches": 0, "skipped": 5, "failed": 1, "usage_rows": 0, "total_batches": 6}
    put(box, "batch-5.json.gz", batch(9, 90))
    put(box, "batch-0.json.gz", batch(12, 0))
    put(box, "batch-1.json.gz", batch(10, 7) | {"os_user": "other"})
    put(box, "batch-9.json.gz", batch(5, 36))
    assert read(100) == {"batches": 4, "skipped": 3, "failed": 0, "usage_rows": 9 + 3, "total_batches": 7}
    n = {r.session_id: r.turns for r in current(spark, root, "sessions", cube.SCHEMAS["sessions"]).collect()}
    assert sum(n.values()) == 50
    assert current(spark, root, "cube", cube.SCHEMAS["cube"]).agg(F.sum("n"), F.sum("i")).first()[:] == (50, sum(range(41)) + sum(range(90, 99)))


def test_a_stream_keeps_the_cube(spark, tmp_path):
    box, root, check = tmp_path / "in", str(tmp_path / "root"), str(tmp_path / "check")
    for step in range(2):
        for k in range(3):
            put(box, f"batch-{step}{k}.json.gz", batch(10, 20 * step + 7 * k))
        cube.keep_up(stream.deduplicated(inbox.stream_batches(spark, str(box), 2)), root, check, *rule()).awaitTermination()
    assert current(spark, root, "cube", cube.SCHEMAS["cube"]).agg(F.sum("n"), F.sum("i")).first()[:] == (44, sum(range(44)))
