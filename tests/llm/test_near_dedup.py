import random

import xxhash

from tallyforge.llm.common import stored
from tallyforge.llm.near_dedup import components, fingerprint, hex_digits, links, near_dedup
from pyspark.sql import functions as F


def plain(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(nodes, edges):
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_definition():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 30, 700):
        text = " ".join(r.choice("One tWo three vier É ß").strip() or "x" for _ in range(n))
        assert fingerprint(text, 3) & (1 << 64) - 1 == plain(text)
    assert fingerprint(None, 3) == 0


def test_links_find_every_close_pair(spark):
    r = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(6):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = sorted((a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect())
    want = [(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2]
    assert len(got) == len(set(got)) == len(want) // 2
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want}


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 50)] + [(r.randint(600, 900), r.randint(600, 900)) for _ in range(200)]
    edges = [e for e in edges if e[0] != e[1]]
    rank = {n: (n * 7919) % 1009 for n in range(1000)}
    nodes = stored(spark.createDataFrame([(n, (k, n)) for n, k in rank.items()], "fp long, rank struct<id long, fp long>"))
    got = {x.fp: x.root.id for x in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots([rank[n] for n in range(1000)], [(rank[a], rank[b]) for a, b in edges])
    assert got == {n: want[rank[n]] for n in range(1000)}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_dedup(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.select("doc_id", hex_digits(out.fp).alias("fingerprint"), "component_id").collect()}
    fp = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = roots(list(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, fp string, root string"
    rows = [(3, None, "", ""), (None, "", "", ""), (2, " \n", "", ""), (None, "a b c d", "", ""), (9, "x " * 50_000, "", ""), (9, "x " * 50_000, "", "")]
    got = sorted((r.doc_id or 0, r.fp == 0, r.component_id) for r in near_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, False, None), (0, True, 2), (2, True, 2), (3, True, 2), (9, False, 9), (9, False, 9)]
    assert near_dedup(spark.createDataFrame([], schema)).count() == 0
    assert near_dedup(spark.createDataFrame([(1, None, "", "")], schema)).select(F.max("component_id")).first()[0] == 1
