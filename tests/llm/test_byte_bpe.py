import base64
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import byte_bpe
from tallyforge.llm.byte_bpe import decode, encode

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}  # noqa: SIM115
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(spark, rows, partitions=3):
    frame = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, ids binary").repartition(partitions)
    out = decode(encode(frame, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = Counter()
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out) == want


TEXTS = ["the cat's  hat\n\n x", "", None, " ", "\t\x0b \x1c\x1f a", "naïve café 漢字かな 한국어", "'S 's 'll it'd", "12 345,6", "  \xa0\x85x", "<|endoftext|> a", "\U0001f600\U0001f468‍\U0001f469", "a" * 300, "é" * 50, "  \n  b", "\x00\x01"]


def test_as_the_library_and_back(spark):
    check(spark, [(i % 70, TEXTS[i % len(TEXTS)]) for i in range(100)] + [(None, "a b"), (None, None)])


@pytest.mark.parametrize(("chars", "words", "sheet", "row", "sent"), [(40, 1 << 19, 2, 3, 5), (1 << 24, 4, 1, 1, 1)])
def test_many_slices(spark, monkeypatch, chars, words, sheet, row, sent):
    for name, value in zip(("SLICE_CHARS", "SLICE_WORDS", "SHEET_DOCS", "ROW_WORDS", "SENT_WORDS"), (chars, words, sheet, row, sent), strict=True):
        monkeypatch.setattr(byte_bpe, name, value)
    rows = [(i, TEXTS[i % len(TEXTS)] or "the the") for i in range(60)]
    cut = list(byte_bpe._cut(iter([_batch(rows)]), public_tokenizers.PATTERN, 7))
    assert len({b.column("slice")[0].as_py() for b in cut}) > 10
    assert _local(cut) == [(i, np.array(LIBRARY.encode_ordinary(t), "<u4").tobytes()) for i, t in rows]


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])


def _local(cut):
    """The steps of encode, one after the other, on the rows of _cut."""
    import pyarrow as pa

    rows = [r for b in cut for r in b.to_pylist()]
    words = sorted(((r["slice"], k, w) for r in rows if r["words"] is not None for k, w in zip(r["places"], r["words"], strict=True)), key=lambda x: x[2].encode())
    parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*words[i : i + 7], strict=True)], ["slice", "place", "word"]) for i in range(0, len(words), 7)]
    sent = [r for b in byte_bpe._encoded(iter(parts), PATH) for r in b.to_pylist()]
    out = []
    for s in sorted({r["slice"] for r in rows}):
        sheets = pa.Table.from_pylist([r for r in rows if r["slice"] == s and r["ids"] is not None])
        out += byte_bpe._by_position(sheets, pa.Table.from_pylist([r for r in sent if r["slice"] == s], byte_bpe._SENT)).to_pylist()
    return [(r["doc_id"], r["ids"]) for r in out]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", "'s", " ", "  ", "\n", "\t", "\xa0", "é", "12", "!?", "\x1f", "한", "́"]) | st.text(max_size=6), max_size=12).map("".join), min_size=20, max_size=40))
def test_any_text(spark, texts):
    check(spark, [(i, t.encode("utf-8", "ignore").decode()) for i, t in enumerate(texts)])


def test_long_texts_and_empty_table(spark):
    check(spark, [(1, "word " * 300_000), (2, "x" * 30_000), (3, " " * 200_000), (4, "漢" * 20_000), (5, "")])
    check(spark, [(1, ""), (2, None)])
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_decoding_ids_of_any_source(spark):
    ids = [LIBRARY.encode_ordinary("hello world"), [], None]
    frame = spark.createDataFrame([(k, None if x is None else np.array(x, "<u4").tobytes()) for k, x in enumerate(ids)], "k int, tokens binary")
    out = {r.k: r.decoded for r in decode(frame, PATH, "tokens").collect()}
    assert {k: v if v is None else bytes(v) for k, v in out.items()} == {0: b"hello world", 1: b"", 2: None}
    bad = spark.createDataFrame([(np.array([50_256], "<u4").tobytes(),)], "ids binary")
    with pytest.raises(Exception, match="has no token"):
        decode(bad, PATH).collect()
