"""Text, pages and merging against plain versions."""

import io
import itertools
import random
import re
import zipfile
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallyforge.functions import pages as P
from tallyforge.functions import text as X
from tallyforge.functions.extract import Patterns, costs_of, near, specs_of, tidy
from tallyforge.operators import board, merge
from tallyforge.plans import board as board_plan
from tallyforge.plans import text as plan
from tallyforge.sources import landing


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_first_long_line_keeps_digits_at_its_ends(spark):
    """A line's place is not taken for the characters to strip (0 of the first line, 1 of the second, and so on)."""
    assert one(spark, X.first_long_line(F.lit("  call 4072374829496490 \nx"), 10)) == ("call 4072374829496490",)
    assert one(spark, X.first_long_line(F.lit("x\n100 lines are 11"), 10, 200)) == ("100 lines are 11",)


def test_keyword_lines_keep_digits_at_their_ends(spark):
    text = "  of 4980 \nthe 555-8971\n  the 555-8971  "
    assert one(spark, X.keyword_lines(F.lit(text), "[0-9]|the"))[0] == ["of 4980", "the 555-8971"]


def test_relevance_has_whole_titles(spark, tmp_path):
    rows = [(1, "password in an error: 5000000000"), (2, "short\nthis is a line of 25 or more, 11"), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.title, r.relevant) for r in board_plan.QUERIES["relevance"](spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], True), 2: ("this is a line of 25 or more, 11", False), 3: (None, False)}


def test_equal_lines_are_read_once():
    seen = []
    found = X.remembered(lambda own: seen.append(own) or [len(own)])
    assert [found(np.array(x)) for x in (["a", "b"], ["a", "b"], ["c"])] == [[2], [2], [1]] and seen == [("a", "b"), ("c",)]


def test_quantities():
    p = plan.PATTERNS
    rows = specs_of("5. AB100 cards 7\nfor each AB100(2 cards), CD200 ( 1 card )\nAB100 won 3 cards\nEF300\n\n 4 cards\nGH400\nCD200 5 cards", p)
    got = [(r["entity"], r["quantity"], r["tokens"], r["score"]) for r in rows]
    assert got == [("Ab-100", "2 cards", "2 cards / 1 card", 3), ("CD200", "1 card", "2 cards / 1 card", 3), ("EF300", "4 cards", "4 cards", 3), ("CD200", "5 cards", "5 cards", 0)]
    assert specs_of("", p) == [] and [r["score"] for r in specs_of("AB100 won 3 cards", p)] == [-9]
    assert len(specs_of("\n".join(f"AB100 {i} cards" for i in range(9)), p)) == 2


NAMES = ["AB100", "CD200", "EF300", "GH400"]
SHOWN = {"AB100": "Ab-100"}


def allocation(pick, kind):
    """A text of one kind that names some entities with quantities, and what is to be found in it."""
    chosen = pick.sample(NAMES, 3)
    cards = lambda: f"{pick.randint(2, 99)} cards"
    want, own = {}, ["3. Allocation of this call 12", "AB100 and CD200 are known for " + "much " * 100 + "1 card"]
    if kind == "list":  # A(2 cards), B/C(1 card, 2 cards)
        one, two = cards(), f"{cards()}, {cards()}"
        own.append(f"for each {chosen[0]}({one}), {chosen[1]}/{chosen[2]} ( {two} )")
        want = {chosen[0]: one, chosen[1]: two, chosen[2]: two}
    elif kind == "cells":  # a cell each: the entity, then its quantity
        for name in chosen:
            q = f"{cards()} a year"
            own += [name, "  per team" if pick.random() < 0.5 else "", q, "no more"]
            want[name] = q
    else:  # prose
        for name in chosen:
            q = cards()
            own.append(pick.choice([f"Teams get of {name} up to {q} at most", f"{name}: {q} - for teams", f"we have {name} with {q}"]))
            want[name] = q if ": " in own[-1] else f"{'up to' if 'up to' in own[-1] else 'with'} {q}"
    return "\n".join(own), {SHOWN.get(k, k): v for k, v in want.items()}


@pytest.mark.parametrize("kind", ["list", "cells", "prose"])
def test_quantities_of_three_kinds_of_text(spark, kind):
    pick = random.Random(kind)
    texts, want = zip(*(allocation(pick, kind) for _ in range(120)), strict=True)
    plain = [{r["entity"]: r["quantity"] for r in specs_of(t, plan.PATTERNS)} for t in texts]
    assert plain == list(want)
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", X.specs(F.col("text"), plan.PATTERNS).alias("s"))
    assert [{x.entity: x.quantity for x in r.s} for r in frame.orderBy("k").collect()] == list(want)


def test_filtered_lines_say_as_much_as_whole_documents(spark):
    """Over documents with entities, quantities and costs put in at random: the column, which reads some lines only, against whole texts."""
    pick = random.Random(3)
    put = ["AB100", "CD200/EF300(3 cards)", "4 cards", "", "1. GH400 7", "(Universities) fee 3 won", "10 won", "fee free", "Companies pay no fee: free", "12 won fee", "x" * 500 + " AB100 2 cards"]
    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        own = (r.text or "").split("\n")
        for _ in range(pick.randrange(9)):
            own.insert(pick.randrange(len(own) + 1), pick.choice(put))
        rows.append((r.doc_id, "\n".join(own)))
    rows += [(-1, None), (-2, "")]
    out = spark.createDataFrame(rows, "k long, text string").repartition(8).select("k", X.specs(F.col("text"), plan.PATTERNS).alias("s"), X.costs(F.col("text"), plan.PATTERNS).alias("c"))
    got = {r.k: ([x.asDict() for x in r.s], [x.asDict() for x in r.c]) for r in out.collect()}
    assert got == {k: (specs_of(t or "", plan.PATTERNS), costs_of(t or "", plan.PATTERNS)) for k, t in rows}
    assert sum(bool(s) for s, _ in got.values()) > 20 < sum(bool(c) for _, c in got.values())


def test_brackets():
    for text, want in (("(2 cards)", "2 cards"), ("((2 cards))", "2 cards"), ("(2) (3)", "(2) (3)"), ("(2 cards, (3", "2 cards, (3)"), (") 2 cards", "2 cards"), (": 2 cards ,", "2 cards"), ("", ""), ("()", ""), ("2 (a) b)", "2 (a) b)")):
        assert tidy(text) == want, text


def test_costs():
    p = Patterns(entity="x", quantity="x", cost="fee|won", bare=r"^\d+ won$", cost_weights=(("won", 4), ("late", -9)), audiences=(("a", "Uni"), ("b", "Com")), exempt=("fee", "none"))
    assert costs_of("Small firms\n30 won\n40 won\nfee late 3 won", p) == [{"audience": "", "text": "Small firms — 30 won"}, {"audience": "", "text": "Small firms — 40 won"}]
    assert costs_of("[Com] fee 30 won\n(Uni) 5 won fee\n(Uni) 5 won fees\n10 won", p) == [{"audience": "a", "text": "5 won fee"}, {"audience": "b", "text": "fee 30 won"}]
    assert costs_of("Uni pay none as fee: 0 won", p) == [{"audience": "a", "text": "Uni pay none as fee: 0 won"}]
    assert near("fee 30 a month", "a fee 30 a month!") and not near("fee 30", "fee 40") and not near("one thing", "nothing else at all")


def test_periods_of_odd_texts(spark):
    keys = ("^Apply", plan.DATE_LIKE, r"Deadline:? *(\d{4}\.\d+\.\d+)")
    apply = lambda t, y=None: one(spark, X.apply_period(F.lit(t), *keys, F.lit(y).cast("string")).alias("p")).p
    assert tuple(apply("Apply soon\nDeadline: 2024.3.9")) == (None, "2024-03-09")
    assert tuple(apply("(~9/16)", "2024")) == (None, "2024-09-16") and tuple(apply("(~9/16)")) == (None, None)
    assert tuple(apply("Apply 2024.2.30 ~ 2024.3.1 at 9:30")) == (None, "2024-03-01T09:30")
    assert tuple(apply("")) == (None, None)
    for text, want in (("24. 2. 9", "2024-02-09"), ("in 99-1-2 and 2023/4/5 15:30", "2023-04-05T15:30"), ("2024-13-01", None), ("2023.4.5 25:00", None), ("none", None)):
        assert one(spark, X.parsed_date(F.lit(text))) [0] == want, text
    assert tuple(one(spark, X.parsed_range(F.lit("2026. 10. 12. ~ 11. 1.")))[0]) == ("2026-10-12", "2026-11-01")


def test_unknown_tokens_once_and_no_notices(spark):
    text = "server ZX10 and ZX10 AB100 no.YY22\nZX11 elsewhere\nserver ISO99 zx12 ZX13"
    got = one(spark, X.unknown_tokens(F.lit(text), r"[A-Z]{2,3}\d{2,4}", "server", F.array(F.lit("AB100")), "^ISO", r"no\.$"))[0]
    assert [r.token for r in got] == ["ZX10", "ZX13"] and got[0].line.startswith("server ZX10")


def test_html(spark):
    markup = "<section>a</section>b<table><tr><td>1</td><td>2 &lt;</td></tr></table><script>x</script>c<br/>d?e?f? g?가"
    assert one(spark, X.html_to_text(F.lit(markup)))[0] == "a\nb1 2 <\nc\nd e f? g 가"
    assert one(spark, X.clean_question_marks(F.lit("why? no\na?b?c")))[0] == "why? no\na b c"


def test_html_references_that_are_not_closed(spark):
    markup = "<h1>a &amp;&amp</h1>&quot;&#233;&ampx; &copy 1&am"
    assert one(spark, X.html_to_text(F.lit(markup)))[0] == 'a &&\n"é&x; © 1&am'
    assert one(spark, X.html_to_text(F.lit(markup), closed=True))[0] == 'a &&amp\n"é&ampx; &copy 1&am'


def test_page_texts_leave_cut_references(spark, tmp_path):
    spark.createDataFrame([(1, "<title>a &amp; b&amp</title><p>c&quot;")], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert board_plan.QUERIES["html_to_text"](spark, str(tmp_path)).first().text == 'a & b&ampc"'


def test_title_tags_equal_plain_ones(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    want = {}
    for r in parts:
        k = r.p_partkey
        title = f"24-{k % 5}th round [{r.p_brand}] {r.p_type}" + (" closed" if k % 4 == 0 else "")
        names = []
        for w in re.findall(r"\b([A-Za-z]+)\b", title):
            label = "Metal" if w.lower() in ("brass", "copper", "nickel", "tin", "steel") else "Any" if w.lower() in ("round", "th", "brand") else w.upper()
            names += [label] if label not in names else []
        names = [n for n in names if n != "Any" or "Metal" not in names]
        tag = "steel" if re.search("(?i)steel", title) else "metal" if re.search("(?i)brass|copper|nickel|tin", title) else None
        want[k] = (tag, f"24-{k % 5}", r.p_brand, k % 4 == 0, "low" if "economy" in title.lower() else "high", ",".join(names))
    got = {r.k: tuple(r)[1:] for r in plan.tags(spark, sf_dir).collect()}
    assert got == want


def test_lines_within_others_go(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    plain = lambda x: re.sub(r"\W", "", x)
    for r in plan.containment_dedupe(spark, sf_dir).collect():
        own = [x for x in (re.sub(r"[ \t\n\x0b\f\r]+", " ", y).strip(" ") for y in docs[r.doc_id].split("\n")) if x]
        kept = []
        for x in own + [f"- {y}!" for y in own[1:2]]:
            if plain(x) and not any(plain(x) in plain(y) or plain(y) in plain(x) for y in kept):
                kept.append(x)
        assert (r.lines or "").split("\n") == (kept or [""])


def test_board_links(spark):
    markup = '<a href="/notice/1">News <b>and</b> more</a><a href="https://other.test/notice">n</a><a href="b?x">plain</a><a class="y" href="//a.test/board"></a><a href="/notice/1">again</a>'
    got = one(spark, X.board_links(F.lit(markup), F.lit("https://a.test/x/y"), "notice|board"))[0]
    assert [tuple(r) for r in got] == [("News and more", "https://a.test/notice/1"), ("https://a.test/board", "https://a.test/board")]


def test_repeated_rows():
    rows = "".join(f"<tr class='r' data-no='{100 + i}'><td onclick=\"go(7777, {5000 + i})\">Title number {i}</td><td>2024-1-{i + 1}</td></tr>" for i in range(6))
    menu = "".join(f"<li><a href='/m{i}'>Menu entry {i}</a></li>" for i in range(9))
    got = P.repeated_rows(f"<ul>{menu}</ul><table>{rows}</table>", "https://a.test/")
    assert [r["number"] for r in got] == [str(100 + i) for i in range(6)] or [r["number"] for r in got] == [str(5000 + i) for i in range(6)]
    assert [r["posted"] for r in got] == [f"2024-01-{i + 1:02}" for i in range(6)]
    linked = "".join(f"<div><a href='v?id={i}'>Title number {i}</a> <span>2024.02.0{i + 1}</span></div>" for i in range(5))
    got = P.repeated_rows(f"<section>{linked}</section>", "https://a.test/list/")
    assert [r["url"] for r in got] == [f"https://a.test/list/v?id={i}" for i in range(5)]
    assert P.repeated_rows(f"<ul>{menu}</ul>", "") == [] == P.repeated_rows("", "") == P.repeated_rows("<a>" * 50, "")


def test_zipped_text(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in (10, 2):
            z.writestr(f"Contents/section{n}.xml", f"<hp:p id='1'><hp:run><hp:t>part {n} &amp;</hp:t><hp:t> more</hp:t></hp:run></hp:p><hp:p><hp:t></hp:t></hp:p>")
    d = spark.createDataFrame([(bytearray(raw.getvalue()),), (bytearray(b"PK\x03\x04 broken"),), (bytearray(b"%PDF"),), (None,)], "c binary")
    assert [r[0] for r in d.select(P.document_text(F.col("c"))).collect()] == ["part 2 & more\npart 10 & more", "", "", ""]


def test_landed_lists_become_records(spark, tmp_path):
    (tmp_path / "in" / "one").mkdir(parents=True)
    rows = "".join(f"<li><a href='/v;jsessionid=9{i}?id={i}'>Support call {i}{' closed' if i == 2 else ''}</a> 2024.05.0{i + 1}</li>" for i in range(6))
    (tmp_path / "in" / "one" / "p1.html").write_text(f"<ul>{rows}</ul>")
    pages = landing.read_pages(spark, str(tmp_path / "in")).withColumn("page", F.lit(1))
    config = spark.createDataFrame([("one", "The one", "https://one.test/list", None, None)], "key string, label string, list_url string, page_param string, detail_url string")
    listed = landing.listed(pages, config)
    assert sorted(r.url for r in listed.collect()) == [f"https://one.test/v?id={i}" for i in range(6)]
    assert tuple(landing.scanned(pages, listed).first()) == ("one", 1, 6)
    bodies = spark.createDataFrame([("https://one.test/v?id=1", "Apply 2024.6.1 ~ 6.9\nproviders of machines are sought for a long time to come")], "url string, body string")
    out = landing.announced(listed, bodies, wanted="(?i)support", unwanted="call 3", keys="^Apply", date_like=plan.DATE_LIKE, deadline="(?!)()", closed="closed", supplier="providers")
    got = {r.title: r for r in out.collect()}
    assert len(got) == 5 and got["Support call 1"].apply_end == "2024-06-09" and got["Support call 1"].audience == "supplier" and got["Support call 2 closed"].closed_hint
    api = spark.createDataFrame([("one", '{"data": [{"id": 1}, {"id": 2}]}'), ("two", "oops")], "source string, body string")
    assert sorted(r.id for r in landing.api_rows(api, "data array<struct<id int>>", "data").collect()) == [1, 2]
    assert one(spark, landing.table_rows(F.lit("<tr><th>h</th></tr><tr><td>a</td><td class='x'>b</td></tr>")))[0] == [["a", "b"]]


def names(pick, n):
    bases = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 30))) for _ in range(n // 5)]
    out = set()
    for _ in range(n):
        s = list(pick.choice(bases))
        for _ in range(pick.randint(0, 3)):
            at = pick.randrange(len(s) + 1)
            s[at : at + pick.randint(0, 1)] = pick.choice(["x", "", "yz"])
        out.add("".join(s))
    return sorted(out - {""})


def test_candidate_pairs_miss_none(spark):
    own = names(random.Random(8), 150)
    want = {(a, b) for a, b in itertools.combinations(own, 2) if SequenceMatcher(None, a, b).ratio() >= 0.9 or SequenceMatcher(None, b, a).ratio() >= 0.9}
    got = {tuple(r) for r in merge.candidate_pairs(spark.createDataFrame([(x,) for x in own], "core string")).collect()}
    assert want and want <= got and len(got) < len(own) ** 2 / 4


@pytest.mark.parametrize("least", [0.75, 0.9, 0.95])
def test_candidate_pairs_of_long_and_short_names(spark, least):
    pick = random.Random(int(least * 100))
    bases = ["".join(pick.choice("abcdefghijkl ") for _ in range(pick.choice([1, 2, 3, 5, 20, 45, 60, 250]))) for _ in range(16)]
    own = sorted({"".join(pick.choice("abx") if pick.random() < 0.06 else c for c in pick.choice(bases)) + pick.choice(["", "", "z", "q" * 4]) for _ in range(140)})
    want = {(a, b) for a, b in itertools.combinations(own, 2) if SequenceMatcher(None, a, b).ratio() >= least or SequenceMatcher(None, b, a).ratio() >= least}
    got = {tuple(r) for r in merge.candidate_pairs(spark.createDataFrame([(x,) for x in own], "core string"), least).collect()}
    assert len(want) > 15 and want <= got


KEYS = ("uid", "source", "core", "richness", "apply_start", "apply_end", "nth", "tag")
POSTS = "uid int, source string, core string, richness int, apply_start string, apply_end string, nth string, tag string"


def records(pick, own, n, sources=4):
    day = lambda: pick.choice([None, "", "2024-01-05", "2024-01-20", "2024-06-01T09:00"])
    return [(i, f"s{pick.randrange(sources)}", pick.choice(own), pick.randrange(9), day(), day(), pick.choice([None, None, "24-1", "24-2"]), pick.choice([None, "", "t", "u"])) for i in range(n)]


def greedy(rows):
    """The rule, one record after the other."""
    groups, want = [], {}
    for r in sorted((dict(zip(KEYS, x, strict=True)) for x in rows), key=lambda x: (-x["richness"], x["uid"])):
        home = next((g for g in groups if all(merge.same_announcement(r, x, ["tag"]) for x in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(r)
        want[r["uid"]] = home[0]["uid"]
    return want


@pytest.mark.parametrize("chunk", [merge.CHUNK, 7])
def test_groups_are_those_of_the_greedy_rule(spark, chunk):
    pick = random.Random(9)
    rows = records(pick, [*names(pick, 40), None, ""], 160)
    want = greedy(rows)
    got = {r.uid: r.group for r in merge.grouped(spark.createDataFrame(rows, POSTS), ["tag"], chunk=chunk).collect()}
    assert got == want and len(set(want.values())) < 155


def test_settling_equals_the_rule_on_random_graphs():
    """500 sets of records whose names are alike or not as it falls; half of them settled in two steps."""
    pick = random.Random(10)
    for k in range(500):
        own = names(pick, pick.choice([5, 10, 30]))
        rows = records(pick, own, pick.randrange(2, 60), pick.randrange(2, 6))
        want = greedy(rows)
        d = pd.DataFrame(rows, columns=KEYS).sort_values(["richness", "uid"], ascending=[False, True]).reset_index(drop=True)
        d["place"], d["group"] = d.index, np.nan
        links = pd.DataFrame([(a, b) for a, b in itertools.permutations(own, 2) if SequenceMatcher(None, a, b).ratio() >= 0.9], columns=["core", "other"])
        cut = len(d) // 2 if k % 2 else len(d)
        d.loc[: cut - 1, "group"] = merge.settled(d[:cut], links, ["tag"])
        if cut < len(d):
            d.loc[cut:, "group"] = merge.settled(d, links, ["tag"])
        assert {r.uid: d["uid"][int(r.group)] for r in d.itertuples()} == want


def test_one_name_with_most_records(spark):
    pick = random.Random(11)
    rows = records(pick, ["one name of all"] * 9 + ["one name of al", "something else"], 300, 3)
    got = {r.uid: r.group for r in merge.grouped(spark.createDataFrame(rows, POSTS), ["tag"], chunk=40).collect()}
    assert got == greedy(rows)


def test_no_announcements(spark):
    assert merge.grouped(spark.createDataFrame([], POSTS), ["tag"]).collect() == []


def test_candidates_are_few(spark):
    """Names as those of the query's table: nearly every candidate that is compared is alike."""
    own = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select(F.lower(F.regexp_replace(F.concat_ws("", "p_name", "p_brand", "p_type"), r"\W", "")).alias("core")).distinct()
    pairs = merge.candidate_pairs(own).cache()
    real = merge.alike(pairs).select(F.least("core", "other"), F.greatest("core", "other")).distinct().count()
    assert 4000 < real <= pairs.count() < 2 * real


def test_merged_fields(spark):
    rows = [(1, "a", "A", "u1", 5, None, ["x"], False, True, "2024"), (2, "b", "B", "u2", 3, "sum", ["y", "x"], True, False, ""), (3, "c", "C", "u3", 1, "other", [], None, True, "2023"), (4, "a", "A", "u4", 0, "", ["z"], False, True, "2022")]
    d = spark.createDataFrame(rows, "uid int, source string, source_label string, url string, richness int, summary string, entities array<string>, closed_hint boolean, stale boolean, stale_since string")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "uid int, group int")
    got = {r.uid: r for r in merge.merged(d, groups, ["summary"], ["entities"], ["closed_hint"]).collect()}
    r = got[1]
    assert (r.source, r.summary, r.entities, r.closed_hint, r.stale, r.stale_since, r.also_on) == ("a", "sum", ["x", "y"], True, False, "", ["B", "C"])
    assert [x.url for x in r.links] == ["u1", "u2", "u3"] and (got[4].stale, got[4].stale_since, got[4].also_on) == (True, "2022", [])


def test_board_lines(spark):
    assert one(spark, board.distinct_lines(F.array(F.lit("a b"), F.lit("..."), F.lit("A-b"), F.lit("a b c"))))[0] == ["a b", "A-b"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_are_sought_once(spark):
    text = F.concat(F.lit("Apply 2024.2.9 9:30 ~ 3.1 on day "), F.col("id").cast("string"))
    out = spark.range(1).select(X.parsed_range(text).alias("r"))
    assert tuple(out.first().r) == ("2024-02-09T09:30", "2024-03-01")
    assert plan_of(out).count("split(") == 1
    use = spark.range(1).select(X.usage_period(text, "^Apply", "Use", plan.DATE_LIKE, "on", "month").alias("u"))
    assert tuple(use.first().u) == ("Apply 2024.2.9 9:30 ~ 3.1 on day 0", None, "2024-02-09T09:30")
    assert plan_of(use).count("split(") <= 4


def test_known_tokens_are_worked_out_once(spark):
    text = F.concat(F.lit("server ZX10 zx10 ZX10 AB100 ZX11 QQ"), F.col("id") + 12)
    out = spark.range(1).select(X.unknown_tokens(text, r"[A-Z]{2,3}\d{2,4}", "server", X.entities(text, r"(AB\d+)"), "^ISO", r"no\.$", 2).alias("t"))
    assert [r.token for r in out.first().t] == ["ZX10", "ZX11"]
    assert plan_of(out).count("regexp_extract_all(") == 2


def test_lines_are_made_plain_once(spark):
    own = F.array(F.lit("a b"), F.lit("!"), F.lit("a-b"), F.concat(F.lit("c "), F.col("id").cast("string")), F.lit("ab c"), F.lit("d"))
    out = spark.range(1).select(board.distinct_lines(own).alias("x"))
    assert out.first().x == ["a b", "c 0", "d"]
    assert plan_of(out).count("regexp_replace(") == 1


def test_rows_of_failed_sources_are_not_dealt_by_source(spark):
    held = spark.range(40).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), F.lit("1998-06-01 09:00").alias("saved_at"), "id")
    report = spark.createDataFrame([("s0", "", 1), ("s1", "timed out", 0)], "source string, error string, scanned int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, told = board.sources_with_last_good(held.filter("source = 's0'").drop("saved_at"), report, held.filter("source = 's1'"), "1998-06-15")
        kept = board.saved_last_good(held, rows, told, "1998-06-15")
        assert sorted((r.source, r.stale) for r in rows.collect()) == [("s0", False)] * 20 + [("s1", True)] * 20 and kept.count() == 40
        for df, kinds in ((rows, ("LeftSemi",)), (kept, ("LeftSemi", "LeftAnti"))):
            lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
            assert not [x for x in lines if "SortMergeJoin" in x and any(k in x for k in kinds)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
