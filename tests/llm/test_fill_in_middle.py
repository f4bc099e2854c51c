import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm.fill_in_middle import fill_in_middle, restored

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, n string, output int")
    out = fill_in_middle(frame)
    got = out.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(brute(*r) for r in rows)
    assert Counter(r.again for r in got) == Counter(t or "" for _, t in rows)
    return Counter(r.form for r in got)


def test_texts_with_marks_delimiters_blanks_and_nulls(spark):
    texts = ["a b  c\n", "", None, " ", "\t\n a", "\x1f \x1e0 \x1e1\x1f", "one", "<P> x", "a<S>b", "x <M", "<P", "ü 漢字 \U0001f600 é", "a\x0bb\x0cc d", "> <P <S M> <", "\xa0  x"]
    forms = check(spark, [(i, texts[i % len(texts)]) for i in range(900)])
    assert all(forms[f] > 20 for f in ("plain", "spm", "psm"))


def test_long_texts_repeats_and_empty_table(spark):
    # Ids 0 to 29 hold all three forms.
    long = ["w " * 200_000, "x" * 1_000_000, " " * 500_000 + "y", "\x1f" * 100_000, " " * 300_000]
    check(spark, [(i, t) for i in range(30) for t in (long[i % 5],)])
    check(spark, [(5, "a b c"), (5, "a b c"), (5, "d e f g"), (None, "a b c d"), (None, None), (-3, "k l m n")])
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", " ", "\n", "\x1f", "\x1e", "0", "1", "<", "P", "S", "M", ">", "é"]), max_size=14).map("".join), min_size=30, max_size=60))
def test_any_text(spark, texts):
    check(spark, list(enumerate(texts)))
