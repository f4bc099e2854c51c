import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm.token_counts import counter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "ΑΣ ΣΑΣ İx ſ ǅ a\x1cb  c\n\n d<|endoftext|> <|startoftext|>x it's 12'd", "é é 　z q 😀🏽", "DON'T '' 've", "a" * 5000]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "Re", "'s", " ", "\n", "é", "Σ", "ß", "12", "!?", "<|endoftext|>", "\x1f", "한", "ǆ"]) | st.text(max_size=8), max_size=12))
def test_counts_match_the_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert counter(PATH)(text) == library(text)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r.doc_id, len(r.text.encode()), library(r.text), library(r.text) > 2048) for r in docs.collect())
    assert sorted(tuple(r) for r in token_counts(docs, PATH).collect()) == want


def test_odd_texts_nulls_and_empty(spark):
    rows = [(None, None, 1), *((i, t, 1) for i, t in enumerate(ODD)), (0, "", 1)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in got) == sorted((i or 0, library(t or ""), len((t or "").encode())) for i, t, _ in rows)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
