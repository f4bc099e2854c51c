import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm.packing import SEQUENCE, encoder, pack, windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "'s", " ", "  ", "\n", "\t", " ", "é", "12", "!?", "<|endoftext|>", "\x1f", "한"]) | st.text(max_size=8), max_size=12))
def test_ids_match_the_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder(PATH)(text), "<u4").tolist() == ids_of(text)[:-1]


def test_windows_are_the_cheapest():
    r = random.Random(6)
    for _ in range(60):
        at = np.cumsum([0] + [r.randint(1, 5) for _ in range(r.randint(1, 40))])
        cost = np.array([r.choice([0.0, 1.5, 4.0]) for _ in at])
        size, free = 16, (4, 8)
        price = lambda i, j: (0 if at[j] - at[i] in free else size - (at[j] - at[i])) + cost[j] + SEQUENCE  # noqa: E731, B023
        best = [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + price(i, j) for i in range(j) if at[j] - at[i] <= size))
        ends = windows(at, cost, size, free)
        assert sum(price(i, j) for i, j in zip([0, *ends], ends, strict=False)) == best[-1]


def checked(rows, docs, size=2048):
    """rows are pieces of docs, whole and in order; returns the padding as a share of all tokens."""
    left, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        left[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in docs.items():
        ids, pieces = np.array(ids_of(text), "<u4"), sorted(left.pop(i), key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert sum(p.length for p in pieces) == len(ids) and {p.doc_tokens for p in pieces} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    assert not left
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        n = sum(p.length for p in pieces)
        assert 0 < n <= size and all(p.length > 0 for p in pieces)
        total, padding = total + n, padding + (0 if n & (n - 1) == 0 else size - n)
    return padding / total


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = pack(docs, PATH).collect()
    assert checked(rows, {r.doc_id: r.text for r in docs.collect()}) < 0.015
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_long_texts_nulls_and_empty(spark):
    docs = {0: "", 1: None, 2: "word " * 300_000, 3: "x" * 20_000, 4: "a.\n" * 3000}
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, start int").coalesce(1)
    assert checked(pack(frame, PATH).collect(), docs) < 0.02
    assert [r.length for r in pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH).collect()] == [1]
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
