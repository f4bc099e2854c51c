"""Folds over segments: one key with 40 % of the rows, against sequential folds, and how the rows are spread."""

import random

import pytest
from pyspark.sql import functions as F
from tallyforge.operators import folds
from tallyforge.operators.scan import SEGMENT, segmented

ROWS, KIND = 6000, "k string, pos int, at int, v int, part string, has boolean"


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    keys = ["hot"] * 4 + [f"k{i}" for i in range(6)]
    out, level, at = [], {}, 0
    for pos in range(ROWS):
        k = None if pos % 97 == 0 else pick.choice(keys)
        at += pick.randrange(3)
        level[k] = level.get(k, 500) + pick.choice([-9, -3, -1, 0, 0, 1, 4])
        out.append((k, pos, at + pick.randrange(-40, 40), pick.choice([None, level[k], level[k]]), pick.choice([None, f"p{pos}"]), pick.random() < 0.3))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    shuffled = list(rows)
    random.Random(6).shuffle(shuffled)
    return spark.createDataFrame(shuffled, KIND).repartition(4)


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_changes_walk_over_partitions_and_not_over_single_keys(frame):
    plan = folds.changes(frame, ["k"], ["pos"], "v", 5)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_a_hot_key_lies_in_many_segments(frame):
    cut = segmented(frame, ["k"], ["pos"])
    sizes = sorted(r["count"] for r in cut.groupBy(SEGMENT).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert cut.filter("k = 'hot'").select(SEGMENT).distinct().count() >= 3


def test_guarded_values_and_parts(frame, rows):
    want, parts = {}, {}
    for k, own in by_key(rows).items():
        value = most = None
        part, stamp, seen = None, None, None
        for _, _, at, v, p, has in own:
            if v is not None and (most is None or at >= most):
                value = v
            most = at if most is None else max(most, at)
            if has and (seen is None or at >= seen):
                part, stamp = p, at
            seen = at if seen is None else max(seen, at)
        want[k], parts[k] = (value, most), (part, stamp)
    assert {r.k: (r.v, r.at) for r in folds.guarded_latest(frame, ["k"], ["pos"], "v", "at").collect()} == want
    assert {r.k: (r.part, r.part_at) for r in folds.carried_forward(frame, ["k"], ["pos"], "at", F.col("has"), "part").collect()} == parts


@pytest.mark.parametrize("least", [0, 5, 40])
def test_changes(frame, rows, least):
    want = set()
    for own in by_key(rows).values():
        held = None
        for r in own:
            if r[3] is not None and (held is None or abs(r[3] - held) > least):
                held = r[3]
                want.add(r[1])
    got = [r.pos for r in folds.changes(frame, ["k"], ["pos"], "v", least).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("initial", [None, 700])
def test_spent(frame, rows, initial):
    since, want = 2000, {}
    for k, own in by_key([r for r in rows if r[3] is not None]).items():
        spent, before, last = 0, None, initial
        for _, _, at, v, _, _ in own:
            if at >= since and last is not None:
                spent += max(0, last - v)
            before, last = (v if at < since else before), v
        first = own[0][3]
        anchor = before if before is not None else initial if initial is not None else first
        want[k] = (spent, anchor, since if before is not None or initial is not None else min(r[2] for r in own))
    known = frame.filter("v is not null")
    got = folds.spent_since(known, ["k"], ["pos"], "v", "at", F.lit(since), None if initial is None else F.lit(initial))
    assert {r.k: (r.spent, r.anchor, r.since) for r in got.collect()} == want


def test_as_of_many(spark, frame, rows):
    pick = random.Random(7)
    keys = ["hot", "k1", "other"]
    asked = [(pick.choice(keys), pick.randrange(-50, 7000), n) for n in range(300)]
    own = by_key(sorted((r for r in rows if r[3] is not None), key=lambda r: (r[2], r[1])))
    want = {n: next((r[3] for r in reversed(own.get(k, [])) if r[2] < at), None) for k, at, n in asked}
    out = folds.as_of_many(spark.createDataFrame(asked, "k string, at int, n int"), frame.filter("v is not null"), ["k"], "v", "at", ["pos"])
    assert {r.n: r.v for r in out.collect()} == want


def test_empty(frame):
    none = frame.limit(0)
    assert folds.guarded_latest(none, ["k"], ["pos"], "v", "at").isEmpty() and folds.changes(none, ["k"], ["pos"], "v", 3).isEmpty()
    assert folds.spent_since(none, ["k"], ["pos"], "v", "at", F.lit(3)).isEmpty() and folds.as_of_many(none.select("k", "at"), none, ["k"], "v", "at", ["pos"]).isEmpty()
