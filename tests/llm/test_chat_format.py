import json
import random

import duckdb

from tallyforge.llm.chat_format import Parameter, levels, link_tool_calls
from tallyforge.llm.registry import OP5_SQL, op5_tool_calls

SCHEMA = "conv_id long, turn long, kind string, id string, name string, payload string, after array<string>"
TOOLS = {"add": {"a": Parameter("integer", True), "b": Parameter("number"), "mode": Parameter("string", longest=3, choices=("abc", "x"))}, "none": {}}


def run(spark, rows):
    return link_tool_calls(spark.createDataFrame(rows, SCHEMA), TOOLS)


def errors(spark, name, payload):
    rows = [(1, 1, "call", "i", name, payload, None), (1, 2, "result", "i", None, "r", None)]
    return run(spark, rows).filter("kind = 'call'").first().errors


def test_arguments_are_checked_against_schemas(spark):
    assert errors(spark, "add", '{"a": 1, "b": 2.5, "mode": "x"}') == []
    assert errors(spark, "add", '{"a": 1.5, "mode": "abcd", "z": 0, "c": null}') == ["not of kind integer: a", "too long: mode", "not a choice: mode", "unexpected: c", "unexpected: z"]
    assert errors(spark, "add", "{}") == ["missing: a"]
    assert errors(spark, "add", "[1]") == ["not a JSON object"] == errors(spark, "add", "{") == errors(spark, "add", None)
    assert errors(spark, "other", "{}") == ["unknown tool"] == errors(spark, None, "{}")
    assert errors(spark, "none", "{}") == []


def test_links_order_and_json(spark):
    rows = [
        (1, 0, "message", None, "system", "be\n", None),
        (1, 1, "call", "a", "add", '{"b": 2, "a": {"y": 1, "x": [1, 1.0]}}', ["b"]),
        (1, 2, "call", "b", "add", "oops", None),
        (1, 3, "result", "a", None, None, None),
        (1, 4, "result", "b", None, 'é"', None),
        (1, 5, "result", "z", None, "orphan", None),
        (2, 1, "call", "a", "none", "{}", ["lost"]),
        (3, 1, "call", "p", "none", "{}", ["q"]),
        (3, 2, "call", "q", "none", "{}", ["p"]),
        (3, 3, "call", "r", "none", "{}", ["q", "q"]),
        (3, 4, "call", "s", "none", "{}", None),
        (None, 1, "call", "a", "none", "{}", None),
        (4, 1, "call", None, "none", "{}", None),
        (5, 2, "call", "a", "none", "{}", None),
        (5, 2, "call", "a", "none", "{}", None),
        (5, 1, "result", "a", None, "", None),
        (5, 1, "result", "a", None, "", None),
        (None, None, None, None, None, None, None),
    ]
    out = run(spark, rows).collect()
    assert len(out) == len(rows)
    at = {(r.conv_id, r.turn): r for r in out}
    assert at[1, 1].json == '{"arguments":{"a":{"x":[1,1],"y":1},"b":2},"id":"a","name":"add","type":"call"}'
    assert at[1, 2].json == '{"arguments":"oops","id":"b","name":"add","type":"call"}'
    assert at[1, 0].json == '{"content":"be\\n","role":"system","type":"message"}' and at[1, 4].json == '{"content":"é\\"","id":"b","type":"result"}'
    assert (at[1, 1].partner_turn, at[1, 3].partner_turn, at[1, 5].partner_turn) == (3, 1, None)
    assert (at[1, 2].level, at[1, 1].level, at[1, 4].level, at[1, 3].level) == (0, 1, 0, 1)
    assert at[1, 5].errors == ["no call"] and at[2, 1].errors == ["no result", "unknown need"]
    assert [at[3, t].level for t in (1, 2, 3, 4)] == [None, None, None, 0] and "cycle" in at[3, 3].errors
    assert at[None, 1].errors == ["no id"] == at[4, 1].errors
    assert at[5, 2].errors == ["repeated id", "result before call"] and at[5, 1].errors == ["repeated result"]
    assert at[None, None].kind == "message" and at[None, None].json == '{"type":"message"}'
    assert run(spark, []).collect() == []


def test_levels_are_longest_chains(spark):
    pick = random.Random(3)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in ((pick.randrange(30), pick.randrange(30)) for _ in range(45)) if a > b})
    nodes = [(f"n{i}",) for i in range(30)]
    needs = {n: [b for a, b in edges if a == n] for (n,) in nodes}

    def depth(n):
        return 1 + max(map(depth, needs[n]), default=-1)

    out = levels(spark.createDataFrame(nodes, "node string"), spark.createDataFrame(edges, "node string, needs string"))
    assert {r.node: r.level for r in out.collect()} == {n: depth(n) for (n,) in nodes}


def test_query_equals_its_sql(spark, sf_dir):
    d = duckdb.connect()
    d.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    names = [x[0] for x in d.execute(OP5_SQL).description]
    want = sorted(d.execute(OP5_SQL).fetchall())
    got = sorted(tuple(r) for r in op5_tool_calls(spark, sf_dir).select(*names).collect())
    assert got == want
    assert all(json.loads(r[-1]) for r in got)


def test_levels_of_long_chains_stars_and_cycles(spark):
    pick = random.Random(6)
    needs = {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(700)}  # a chain
    needs |= {f"s{i}": {"c699"} for i in range(200)}  # many that need its end
    needs |= {f"d{i}": {f"d{j}" for j in pick.sample(range(i), min(i, pick.randint(0, 3)))} | ({"c40"} if i % 7 == 0 else set()) for i in range(60)}  # some need several
    needs |= {f"r{i}": {f"r{(i + 1) % 5}"} for i in range(5)} | {"behind": {"r2"}, "both": {"r1", "c3"}, "after": {"both"}, "self": {"self"}}
    level = {}
    while found := {n: 1 + max((level[x] for x in own), default=-1) for n, own in needs.items() if n not in level and all(x in level for x in own)}:
        level |= found
    nodes = spark.createDataFrame([(n,) for n in needs], "node string")
    edges = spark.createDataFrame([(n, x) for n, own in needs.items() for x in own], "node string, needs string")
    got = {r.node: r.level for r in levels(nodes, edges).collect()}
    assert got == {n: level.get(n) for n in needs} and got["c699"] == 699 and got["s7"] == 700 and got["after"] is None


def test_query_has_calls_on_several_levels(spark):
    out = op5_tool_calls(spark, "/root/testdata/sf0.01").groupBy("kind", "level").count().collect()
    assert sum(r["count"] for r in out if r.kind == "call" and r.level > 0) > 20


def test_further_columns_and_long_payloads(spark):
    long = json.dumps({"a": 1, "mode": "x" * 1_000_000})
    d = spark.createDataFrame([(1, 1, "call", "i", "add", long, None, 5, "z"), (1, 2, "result", "i", None, "r" * 1_000_000, None, 5, "z")], SCHEMA + ", level int, _key string")
    a, b = link_tool_calls(d, TOOLS).orderBy("turn").collect()
    assert a.level == 0 and a.errors == ["too long: mode", "not a choice: mode"] and len(b.json) > 1_000_000
