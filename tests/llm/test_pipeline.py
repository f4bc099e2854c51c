"""Each stage against a plain version, on the smallest tables and planted documents."""

import hashlib

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tallyforge.llm.decontaminate import words
from tallyforge.llm.near_dedup import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).orderBy("doc_id").collect()]
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    more = [(90001, rows[3][1] + "  \n", "en", "x", 1), (90002, None, None, None, None), (90002, None, None, None, None), (None, "a b c", "en", "x", 5), (90003, "so " + leak + " it is", "en", "x", 9), (90004, rows[5][1], "en", "x", 9)]
    return spark.createDataFrame(rows + more, docs.select(*COLUMNS).schema), rows + more


def test_exact_dedup_keeps_one_of_each_text(spark, sf_dir, planted):
    docs, rows = planted
    out = P.without_copies(spark, docs, sf_dir)
    assert out.columns == COLUMNS
    best = {}
    for r in rows:
        text = r[1] or ""
        key = hashlib.sha256("".join(c for c in text if c not in " \t\n\r\x0b\x0c").encode()).digest()
        best[key] = min(best.get(key, (1, 0)), (-len(text), r[0] if r[0] is not None else 2**63))
    want = sorted(i for _, i in best.values())
    assert sorted(r.doc_id if r.doc_id is not None else 2**63 for r in out.collect()) == want


def test_near_dedup_keeps_one_of_each_group(spark, sf_dir, planted):
    docs, rows = planted
    fps = [(r[0] if r[0] is not None else 2**63, fingerprint(r[1], 3) & (2**64 - 1)) for r in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    want = sorted({find(i): min(fps[j][0] for j in range(len(fps)) if find(j) == find(i)) for i in range(len(fps))}.values())
    out = P.without_near_copies(spark, docs, sf_dir)
    assert out.columns == COLUMNS
    assert sorted(r.doc_id if r.doc_id is not None else 2**63 for r in out.collect()) == want


def test_decontamination_keeps_documents_without_benchmark_windows(spark, sf_dir, planted):
    docs, rows = planted
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    out = P.without_benchmark(spark, docs, sf_dir)
    assert out.columns == COLUMNS
    want = [r[0] for r in rows if not any(tuple(w[i : i + 10]) in windows for w in [words(r[1])] for i in range(len(w)))]
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(i or -1 for i in want)
    assert 90003 not in want and len(want) > 100


def test_toxic_documents_go(spark, sf_dir, planted):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS)
    odd = planted[0].filter("doc_id is null or doc_id = 90002")
    toxic = spark.createDataFrame([(i, "an idiot and a moron, what a clown", "en", "x", 3) for i in (91000, 91001)], docs.schema)
    out = P.without_toxic(spark, docs.union(odd).union(toxic), "/root/testdata/sf0.01")
    assert out.columns == COLUMNS
    left = {r.doc_id for r in out.collect()}
    assert not left & {91000, 91001} and {90002, None} <= left and len(left) > 800


def test_the_whole_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sums = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert sums.filter("n <> t").isEmpty() and sums.count() > 100


def test_empty_documents(spark, sf_dir, planted):
    none = planted[0].limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


@pytest.fixture(scope="module")
def no_tables(spark, sf_dir, tmp_path_factory):
    """A folder whose labels and benchmark have no rows."""
    where = str(tmp_path_factory.mktemp("none"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    return where


def test_odd_documents_pass_all_stages(spark, no_tables):
    """Nulls in every column, very long texts, repeated rows, columns with names that the stages use themselves, and neither labels nor a benchmark."""
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, "a b c", "en", "x", 5, "own", 7), (2, None, None, None, None, None, None), (None, "", "en", "x", 0, "own", 7), (3, long, "en", "x", 9, None, 7), (4, long + " end", "en", "x", 9, "own", None), (5, "x" * 400_000, "en", "x", 9, "own", 7), (1, "a b c", "en", "x", 5, "own", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, fp long")
    left = {"toxicity": [1, 1, 2, 3, 4, 5, None], "exact_dedup": [1, 2, 3, 4, 5], "simhash_near_dedup": [1, 2, 3, 5], "benchmark_decontamination": [1, 2, 3, 5]}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, no_tables)
        assert docs.columns == [*COLUMNS, "_text", "fp"]
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is None, x)) == left[name], name
    packed = P.STAGES[-1][1](spark, docs, no_tables)
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert sums.filter("n <> t").isEmpty() and sorted(r.doc_id for r in sums.collect()) == [1, 2, 3, 5]
