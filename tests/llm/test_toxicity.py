import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyforge.llm.toxicity import fit, toxicity

BAD = ["grobal", "grobelin", "grobust", "nastor"]


def corpus(n: int, seed: int):
    pick = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = [pick.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(pick.randint(5, 60))]
        toxic, poor = i % 4 == 0, i % 3 == 0
        if toxic:
            text[pick.randrange(len(text))] = pick.choice(BAD).upper() + ","
        if poor:
            text.insert(0, "###buy now###")
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return docs, labels


def test_finds_toxic_texts_that_it_has_not_learnt_from(spark):
    docs, labels = corpus(400, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string, probabilities string")
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity(d, known).collect()}
    assert len(out) == 400
    wrong = [i for i in range(300, 400) if out[i].toxic != bool(labels[i][2])]
    assert not wrong
    assert all((out[i].probabilities[0] > 0.5) == (labels[i][1] == 0) for i in range(300, 400))


def test_later_links_get_the_earlier_probabilities(spark):
    """A category that copies the first one, where the features of the first are all there is."""
    docs, labels = corpus(200, 2)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = fit(d, known, {"a": F.col("toxic") == 1, "b": F.col("toxic") == 1})
    assert len(chain.links[0].earlier) == 0 and len(chain.links[1].earlier) == 1 and chain.links[1].earlier[0] > 0


def test_nulls_empty_and_repeated_rows(spark):
    docs, labels = corpus(100, 3)
    d = spark.createDataFrame([x[:2] for x in docs] + [(None, "nastor"), (7, None), (7, None), (8, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (99999, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity(d, known)
    assert out.count() == 104
    assert [r.toxic for r in out.filter("doc_id is null").collect()] == [True]
    assert not any(r.toxic for r in out.filter("text is null or text = ''").collect())


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in toxicity(d, none).collect()] == [False]
    assert toxicity(d.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in toxicity(d, one).collect()] == [False]


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    out = toxicity(docs.select("doc_id", "text"), labels.filter(~held))
    rows = out.join(labels.filter(held).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert sum(r.toxic == (r.y == 1) for r in rows) / len(rows) > 0.95


def features(text):
    own = set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)})))
    return own | {w[:k] + "*" for w in own for k in (4, 5, 6, 7) if len(w) > k}


def g2(rows, y, f):
    out = 0.0
    for has in (0, 1):
        for is_y in (0, 1):
            n = sum((f in own) == has and label[y] == is_y for own, label in rows)
            expected = sum((f in own) == has for own, _ in rows) * sum(label[y] == is_y for _, label in rows) / len(rows)
            out += 2 * n * math.log(n / expected) if n else 0.0
    return out


def plain_regression(x, y, l2=1e-3):
    """Newton's steps on the mean log loss and l2 / 2 times the squared weights, the intercept free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x / len(x) + ridge + 1e-12 * np.eye(len(w)), x.T @ (p - y) / len(x) + ridge @ w)
    return lambda z: 1 / (1 + np.exp(-np.hstack([z, np.ones((len(z), 1))]) @ w))


def test_chain_equals_a_plain_one(spark):
    docs, labels = corpus(500, 4)
    pick = random.Random(5)
    labels = [(i, q, t if pick.random() < 0.85 else 1 - t) for i, q, t in labels]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    got = {r.doc_id: r.probabilities for r in toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    fold = {r.doc_id: r.f for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("f")).collect()}
    rows = [(features(t), (int(q == 0), x)) for (_, t, _), (_, q, x) in zip(docs, labels, strict=True)]
    every = [f for f in sorted(set().union(*(own for own, _ in rows))) if sum(f in own for own, _ in rows) >= 3]
    chosen = [f for f in every if any(g2(rows, y, f) >= 20 for y in (0, 1))]
    x = np.array([[f in own for f in chosen] for own, _ in rows], float)
    want, held = [], x
    for y in (0, 1):
        target = np.array([label[y] for _, label in rows], float)
        inputs = x if y == 0 else np.hstack([x, np.array(want[:1]).T])
        want.append(plain_regression(held, target)(inputs))
        folds = np.array([fold[i] for i, *_ in docs])
        out = np.zeros(len(rows))
        for k in range(4):
            out[folds == k] = plain_regression(held[folds != k], target[folds != k])(held[folds == k])
        held = np.hstack([held, out[:, None]])
    assert len(chosen) > 4 and 0.2 < want[1].std()
    for j, (i, *_) in enumerate(docs):
        assert got[i][0] == pytest.approx(want[0][j], abs=0.02) and got[i][1] == pytest.approx(want[1][j], abs=0.02)
