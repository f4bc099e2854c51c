import random

from tallyforge.llm.substring_dedup import COVERS, substring_dedup


def brute(rows, window):
    words = [(d, [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def got(spark, rows, **more):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k int, starts string")
    return sorted((tuple(r) for r in substring_dedup(frame, **more).collect()), key=lambda r: (r[0] is None, r))


def test_covers():
    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_against_brute_force(spark):
    r = random.Random(7)
    passages = [[f"p{k}w{r.randint(0, 9)}" for _ in range(r.randint(15, 70))] for k in range(4)]
    rows = []
    for i in range(80):
        w = [f"u{r.randint(0, 10**6)}" for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 10)
            w += p[a : a + r.randint(9, 70)] + [f"u{r.randint(0, 10**6)}" for _ in range(r.randint(0, 12))]
        rows.append((r.randint(0, 10**6), " ".join(w)))
    for window in (20, 8):
        want = brute(rows, window)
        assert got(spark, rows, window=window) == want
        assert sum(x[2] > 0 for x in want) > 20


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows, 50)
    assert got(spark, rows) == want and any(x[2] for x in want)


def test_nulls_repeats_long_and_empty(spark):
    long, same = " ".join(f"w{i % 5000}" for i in range(60_000)), " ".join(f"s{i}" for i in range(60))
    rows = [(1, long), (2, "lead " + long), (3, None), (4, ""), (5, same), (5, same), (None, same)]
    out = got(spark, rows)
    assert [r[:3] for r in out] == [(1, 60_000, 0), (2, 60_001, 60_000), (3, 0, 0), (4, 0, 0), (5, 60, 0), (5, 60, 0), (None, 60, 60)]
    assert out[1][3] == "lead"
    assert got(spark, []) == []
