import random
import re

from tallyforge.llm.decontaminate import contamination

SEP = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return SEP.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    out = []
    for i, t in docs:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            m = min(window, len(w))
            for k in range(len(w) - m + 1) if w else []:
                for at in range(len(own) - m + 1):
                    if own[at : at + m] == w[k : k + m]:
                        hit |= set(range(at, at + m))
                        found.add(str(item))
        out.append((i, len(own), sorted(hit), sorted(found)))
    return sorted(out)


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hit string")
    return sorted(tuple(r) for r in contamination(d, b, **more).select("doc_id", "n_words", "hit", "items").collect())


def test_against_brute_force(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(["a", "B", "c-d", "é", "7"]) for _ in range(n))
    items = [(i, text(r.randint(1, 9))) for i in range(12)] + [(90, ""), (91, None), (92, "...")]
    docs = [(i, text(r.randint(0, 40))) for i in range(60)] + [(100, None), (101, items[0][1])]
    want = brute(docs, items, 4)
    assert got(spark, docs, items, window=4) == want
    assert got(spark, docs, items, window=4, block_bytes=20) == want  # several scans
    assert sum(bool(x[2]) for x in want) > 20


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = got(spark, docs, items)
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for i, n, hit, found in out:
        own = words(dict(docs)[i])
        at = [k for k in range(len(own) - 9) if tuple(own[k : k + 10]) in grams]
        assert (n, hit, found) == (len(own), sorted({x for k in at for x in range(k, k + 10)}), sorted(set().union(*(grams[tuple(own[k : k + 10])] for k in at))))
    assert any(x[2] for x in out)


def test_nulls_repeats_and_empty(spark):
    docs = [(None, "x y z"), (1, "x y z"), (1, "x y z"), (2, "q " * 60_000)]
    out = got(spark, [(i or 0, t) for i, t in docs], [(5, "y"), (5, "y"), (None, "z"), (6, "Q Q")])
    assert out[0] == (0, 3, [1, 2], ["5"]) and out[1] == out[2] and len(out[3][2]) == 60_000
    assert got(spark, [], [(1, "a")]) == []
    assert got(spark, [(1, "a")], []) == [(1, 1, [], [])]
    d = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in contamination(d, spark.createDataFrame([], "item_id long, text string")).collect()] == [(None, 0, [], [])]
