"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import itertools
import random
from collections import Counter

import numpy as np

import corpus_pipeline as P
from tallyforge.llm.near_dedup import shingle_set


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """The smallest id of each component of pairs with a similarity of 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 2**63), 2**63 if k is None else k)
    return sorted(least.values())


def stage(spark, rows, sf_dir):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (near,) = [f for name, f in P.STAGES if name == "simhash_near_dedup"]
    return sorted(2**63 if r.doc_id is None else r.doc_id for r in near(spark, docs, sf_dir).collect())


def test_set_of_shingles():
    for text in (None, " \n", "a", "a b c d", "a b c d e", "A b c d e a B c d e a b", "x " * 9000):
        assert len(shingle_set(text, 5)) == len(shingles(text))
    assert (shingle_set("A  b\tc D e f", 5) == shingle_set("a b c d e f", 5)).all()


def test_stage_drops_copies_at_a_similarity_of_08(spark, sf_dir):
    r = random.Random(3)
    rows = []
    for i in range(40):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(40, 200))]
        rows.append((i, " ".join(base)))
        for k in range(4):  # 1 to 6 % of the words changed: similarities from about 0.95 to 0.6
            words = [f"c{r.randint(0, 5000)}" if r.random() < 0.01 * (k + 1) * 1.5 else w for w in base]
            rows.append((1000 + 10 * i + k, " ".join(words)))
    rows += [(5000, None), (5001, ""), (None, "a b"), (5002, "A b"), (5003, "x y z v w u")]
    r.shuffle(rows)
    assert stage(spark, rows, sf_dir) == kept(rows)


def test_chain_and_large_group(spark, sf_dir):
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 20 : i * 20 + 200])) for i in range(10)]
    base = [f"b{i}" for i in range(150)]
    r = random.Random(4)
    group = [(100 + i, " ".join(f"x{i}" if r.random() < 0.03 else w for w in base)) for i in range(120)]
    assert stage(spark, chain + group, sf_dir) == kept(chain + group)


def test_documents(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert stage(spark, rows, sf_dir) == kept(rows)


def test_every_similar_pair_of_a_larger_table_meets(spark):
    """All pairs of different sets with a similarity of 0.8 or more, by brute force over shared shingles: each has a segment from which its chain holds."""
    from tallyforge.llm.near_dedup import BUDGET, PARTS, minima, parts_of, ring_of

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sets = list({x.tobytes(): set(x.tolist()) for x in (shingle_set(t, 5) for t in texts)}.values())
    pick = random.Random(8)
    for n in range(90, 390):  # planted pairs of 0.8 to 0.84
        own = [pick.getrandbits(64) for _ in range(n)]
        same = -(-n * 8 // 9)
        sets += [set(own), set(own[:same] + [pick.getrandbits(64) for _ in range(n - same)])]
    where, shared = {}, Counter()
    for k, own in enumerate(sets):
        for h in own:
            where.setdefault(h, []).append(k)
    for own in where.values():
        shared.update(itertools.combinations(own, 2))
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(pairs) >= 303
    met = 0
    for a, b in pairs:
        x, y = (minima(np.array(sorted(sets[k]), np.uint64)) for k in (a, b))
        apart = [(int(i) ^ int(j)).bit_count() for i, j in zip(*(np.array(ring_of(m), np.int64).view(np.uint16) for m in (x, y)), strict=True)]
        starts = [i for i, (p, q) in enumerate(zip(parts_of(x), parts_of(y), strict=True)) if p == q]
        met += any(all(sum(apart[(i + j) % PARTS] for j in range(n)) <= n * BUDGET / PARTS for n in range(1, PARTS + 1)) for i in starts)
    assert met >= 0.99 * len(pairs)


def test_pairs_of_a_large_key_are_no_rows(spark, sf_dir, monkeypatch):
    """Edits of one text, most of them alike by less than 0.8: their pairs, which grow with the square of the group, are compared within blocks."""
    from tallyforge.llm import near_dedup

    r, asked, confirmed = random.Random(6), [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, sets, least: asked.append(pairs.count()) or confirmed(pairs, sets, least))
    base, rows = [f"b{i}" for i in range(300)], []
    for i in range(240):
        words = list(base)
        for k in r.sample(range(300), r.choice((3, 4, 4, 4, 5))):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "ROOM", 20_000, raising=False)  # several blocks a side
    assert stage(spark, rows, sf_dir) == kept(rows)
    assert sum(asked) < 20 * len(rows)
