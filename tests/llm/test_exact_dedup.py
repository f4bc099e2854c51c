import hashlib
import random

from tallyforge.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, kept string, group_size long"


def brute(rows):
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c")
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[strip(t)]
        out.append((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, **more):
    out = exact_dedup(spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA), **more)
    return sorted(tuple(r) for r in out.collect())


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = ["a b", "ab", " a\nb ", "", None, " \t", "é" * 70 + "x", "é" * 70 + "y", " ab", "long " * 40_000]
    rows = [(i, r.choice(texts)) for i in range(120)] + [(1000 + i, f"alone {i}") for i in range(30)]
    assert got(spark, rows, hash_all=True) == brute(rows)


def test_lone_texts_are_not_hashed(spark):
    out = got(spark, [(1, "a"), (2, "b c"), (3, "bc")])
    assert [(r[0], r[1], r[2], r[3], r[4] is None) for r in out] == [(1, 1, 1, True, True), (2, 2, 2, True, False), (3, 2, 2, False, False)]


def test_nulls_repeats_and_empty(spark):
    assert got(spark, []) == []
    rows = exact_dedup(spark.createDataFrame([(None, "a", "", 1), (5, "a", "", 1), (5, "a", "", 1)], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in rows) == [(0, 5, 3), (5, 5, 3), (5, 5, 3)]
    assert sum(r.kept for r in rows) == 1
