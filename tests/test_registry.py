"""Requests for sources: checks, and putting them in by either key against the rule one after the other."""

import json
import random

from pyspark.sql import functions as F
from tallyforge.sources import registry


def test_internal_addresses(spark):
    bad = ["http://localhost/x", "https://a.internal", "http://10.1.2.3:80/", "http://127.0.0.1", "http://192.168.0.9/b", "http://172.16.0.1", "http://172.31.255.255/", "http://169.254.1.1", "http://[::1]/", "http://[fe80::1]:8/", "http://u@0.0.0.0/", "http://250.1.1.1"]
    good = ["http://172.32.0.1", "http://11.0.0.1/", "https://a.test/localhost", "http://[2001:db8::1]/", "http://192.169.0.1", "http://internal.test", "http://1.2.3.4.5/"]
    d = spark.createDataFrame([(u,) for u in bad + good], "u string")
    got = {r.u: r.i for r in d.select("u", registry.is_internal(registry.host_of(F.col("u"))).alias("i")).collect()}
    assert got == dict.fromkeys(bad, True) | dict.fromkeys(good, False)


def test_requests(spark):
    fine = {"label": " L ", "list_url": "https://www.A-b.test/list?p=1", "pages": 99}
    asked = [fine, fine | {"key": "My Key!", "pages": "0", "page_param": "p_1", "detail_url": "http://a.test/{id}"}, fine | {"evil": 1, "bad": 2}, {"list_url": "http://a.test"}, fine | {"list_url": "ftp://a.test"}, fine | {"list_url": "http://10.0.0.1/"}, fine | {"page_param": "a b"}, fine | {"pages": "many"}, fine | {"detail_url": "http://a.test/1"}, fine | {"detail_url": "http://localhost/{id}"}]
    d = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(asked)] + [(10, "[1]"), (11, None)], "n int, text string")
    rows = {r.n: r for r in registry.checked(d).collect()}
    assert [rows[k].problem for k in range(12)] == [None, None, "unknown: bad, evil", "missing: label", "no web address", "internal address", "odd page parameter", "odd number of pages", "no {id} in the address of details", "internal address of details", "no object", "no object"]
    assert (rows[0].key, rows[0].label, rows[0].pages, rows[0].org) == ("a_b_test", "L", 20, None)
    assert (rows[1].key, rows[1].pages, rows[1].page_param) == ("my_key", 1, "p_1") and rows[2].key is None


def test_upserts_by_either_key(spark):
    for seed in range(4):
        pick = random.Random(seed)
        name = lambda: pick.choice([None, *(f"k{i}" for i in range(9))])
        rows = [(i, f"k{i}", f"u{i}", f"old{i}") for i in pick.sample(range(12), 7)]
        new = [(n, name(), pick.choice([f"u{i}" for i in range(12)]), pick.choice([None, f"new{n}"])) for n in range(25)]
        held = [dict(zip(("place", "key", "list_url", "label"), r, strict=True)) for r in sorted(rows)]
        for n, *asked in new:
            said = dict(zip(("key", "list_url", "label"), asked, strict=True))
            same = next((h for h in held if any(said[k] is not None and h[k] == said[k] for k in ("key", "list_url"))), None)
            if same is None:
                held.append({"place": max(r[0] for r in rows) + 1 + n} | said)
            else:
                same.update({k: v for k, v in said.items() if v is not None})
        out = registry.upserted(spark.createDataFrame(rows, "place long, key string, list_url string, label string"), spark.createDataFrame(new, "n int, key string, list_url string, label string"))
        assert [r.asDict() for r in out.orderBy("place").collect()] == held, seed
