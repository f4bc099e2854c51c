import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.manifest import folded, leaf_digest, manifest, proof_digest

SCHEMA = "doc_id long, lang string, text string, n_chars long, path string, leaf string"
COLUMNS = ["doc_id", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, lang, text, n):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, lang, n, text)))


def climb(nodes, fan):
    """The root, and of each node its siblings by level."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            low = at - at % fan
            run = nodes[low : low + fan]
            proofs[k].append("".join(run[: at - low] + run[at - low + 1 :]))
        nodes = [digest(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        where = [at // fan for at in where]
    return nodes[0], proofs


def brute(rows, fan):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for name in names:
        order = sorted(((r[0] is not None, r[0] or 0, leaf(*r)) for r in trees[name]))
        leaves = [x[2] for x in order]
        subs[name] = ([None if not x[0] else x[1] for x in order], leaves, *climb(leaves, fan))
    root, tops = climb([subs[n][2] for n in names], fan) if names else (None, [])
    return sorted(
        ((i is not None, i or 0, lf, subs[n][2], root, digest(*p, *tops[k])) for k, n in enumerate(names) for i, lf, p in zip(subs[n][0], subs[n][1], subs[n][3], strict=True)),
    )


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "taken", "taken") for r in rows], SCHEMA)
    out = manifest(frame, COLUMNS, "lang", more={"changed": leaf_digest(F.col("doc_id"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))}, **more)
    out = out.withColumn("again", folded(F.col("leaf"), F.col("path"))).withColumn("other", folded(F.col("changed"), F.col("path"))).withColumn("proof", proof_digest(F.col("path")))
    out = out.collect()
    assert all(r.again == r.root and (r.other != r.root or r.changed == r.leaf) for r in out)
    return sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof) for r in out)


@pytest.mark.parametrize(("fan", "depth"), [(2, 12), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_against_brute_force(spark, fan, depth):
    r = random.Random(fan * 10 + depth)
    langs = ["en"] * 30 + ["de"] * 8 + ["", None, "fr", "Ω", "zz", "\U0001f600"]
    rows = [(i * 3 % 400, r.choice(langs), r.choice(["a", "", None, "b c", "é"]), r.choice([None, 1, 5])) for i in range(150)]
    rows += [(900, "alone", "x", 1), (901, "ab", "y", 2), (902, "ab", "y", 2)]
    assert got(spark, rows, fan=fan, depth=depth) == brute(rows, fan)


def test_repeated_rows_nulls_and_long_texts(spark):
    rows = [(5, "en", "a", 1)] * 3 + [(5, "en", "b", 1), (None, "en", "c", None), (None, None, None, None), (None, None, None, None), (7, None, "long " * 300_000, 9)]
    assert got(spark, rows, depth=1) == brute(rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, "en", "a", 1)], [(1, None, None, None)], [(1, "a", "x", 1), (2, "b", "x", 1)], [(i, str(i % 37), "x", 1) for i in range(75)]])
def test_small_tables(spark, rows):
    assert got(spark, rows, depth=2) == brute(rows, 2)


def test_one_tree_over_many_blocks(spark):
    rows = [(i, "en", f"text {i}", i) for i in range(3001)]
    assert got(spark, rows, depth=4) == brute(rows, 2)
