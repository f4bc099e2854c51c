from itertools import combinations

from pyspark.sql import functions as F

from tallyforge.llm.registry import URL_RULES
from tallyforge.llm.url_filter import Index, host, mined, path, tokens, url_filter


def test_host_path_and_tokens(spark):
    rows = [("http://A.Example.COM/x/Y?b=1&c#d",), ("no scheme",), (None,), ("a://b://c/d",), ("x://h?q://z/",), ("ftp://h#://g/",), ("http://h/a\nb?c",)]
    d = spark.createDataFrame(rows, "url string")
    got = d.select(host(d.url), path(d.url)).collect()
    assert [tuple(r) for r in got] == [("a.example.com", "/x/Y"), ("", ""), ("", ""), ("b:", "//c/d"), ("h", ""), ("h", ""), ("h", "/a\nb")]
    one = spark.createDataFrame([("http://www.a.com/en/12.html?page=2&page=3#top",)], "url string")
    assert one.select(tokens(one.url)).first()[0] == ["h=www", "h=a", "h=com", "p=en", "p=0", "p=html", "q=page"]


def test_rules_by_hand(spark):
    urls = ["http://x.com/en/7", "http://com/en/", "http://example.com/en/7", "http://a.example.com/en/71?z", "http://q.net/de/8", "http://www.example.net/de/81", "http://o.org/es/", "http://o.org/esx", "http://notcom/en/1", "http://com/EN/1", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages, labels, F.col("quality") == 0, URL_RULES).collect()}
    assert out == {
        0: ("com/en/", "block"), 1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("example.com/en/7", "allow"), 4: ("net/de/", "allow"),
        5: ("example.net/de/8", "block"), 6: ("org/es/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"),
    }


def test_mined_rules_are_those_of_brute_force(spark):
    import random

    pick = random.Random(5)
    rows = []
    for _ in range(300):
        own = pick.sample("abcdef", pick.randint(1, 5))
        rows.append((own, ("a" in own and "b" in own) or pick.random() < 0.1))
    got = {t: (round(s, 6), round(c, 6)) for t, s, c in mined(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.03, 0.8)}
    every = {}
    for k in range(1, 6):
        for t in combinations("abcdef", k):
            n = [block for own, block in rows if set(t) <= set(own)]
            if n and sum(n) >= max(0.03 * 300, 8) and sum(n) / len(n) >= 0.8:
                every[t] = (round(sum(n) / 300, 6), round(sum(n) / len(n), 6))
    want = {t: x for t, x in every.items() if not any(set(o) < set(t) and every[o][1] >= x[1] for o in every)}
    assert got == want and ("a", "b") in got


def test_index_equals_search_through_all_rules():
    rules = [(("a", "b"), 0.1, 0.9), (("c",), 0.2, 0.85), (("a", "d", "e"), 0.1, 0.8)]
    index = Index(rules)
    for k in range(6):
        for own in combinations("abcdef", k):
            assert index.best(list(own)) == next((i for i, r in enumerate(rules) if set(r[0]) <= set(own)), None)


def test_mined_rules_block_pages_without_a_label(spark):
    pages = [(i, f"https://{'spam' if i % 3 == 0 else 'good'}.host{i % 7}.test/{'win' if i % 2 else 'read'}/{i}") for i in range(240)] + [(None, "https://spam.z.test/win/1"), (5, None), (5, None)]
    labels = [(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(180)] + [(None, 0, 1), (3, None, None)]
    p = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = url_filter(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("quality") == 0, URL_RULES)
    rows = out.collect()
    assert len(rows) == 243
    for r in rows:
        want = r.page_id is None or (r.host != "" and r.page_id % 3 == 0 and r.page_id % 2 == 1)
        assert (r.verdict == "block") == want, r
    assert url_filter(p.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.col("quality") == 0, []).collect() == []


def test_query_rules_come_from_the_ruled_pages(spark):
    """The verdicts of the query's own rules label the pages that they fit; every other page is judged by what brute force finds there."""
    from collections import Counter

    from tallyforge.llm.registry import op4_url_filter

    sf_dir = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    own = {r[0]: frozenset(r[1]) for r in pages.select("page_id", tokens(pages.url)).collect()}
    out = op4_url_filter(spark, sf_dir).collect()
    labelled = {r.page_id: r.verdict == "block" for r in out if r.rule is not None}
    n, k = Counter(), Counter()
    for i, block in labelled.items():
        for size in (1, 2, 3):
            for t in combinations(sorted(own[i]), size):
                n[t] += 1
                k[t] += block
    rules = {t for t in n if k[t] >= max(8, 0.001 * len(labelled)) and k[t] / n[t] >= 0.8}
    fits = lambda i: any(t in rules for size in (1, 2, 3) for t in combinations(sorted(own[i]), size))
    unruled = [r for r in out if r.rule is None]
    for r in unruled:
        assert (r.verdict == "block") == fits(r.page_id) == (r.mined_tokens is not None), r
        assert r.mined_tokens is None or set(r.mined_tokens.split(" ")) <= own[r.page_id]
    assert len(out) == len(own) and sum(r.verdict == "block" for r in unruled) > 10
    assert url_filter(pages.limit(0), None, None, URL_RULES).collect() == []
