"""Documents, configuration, parameters, connectors and the banner on small rows."""

import gzip
import json
import threading

from pyspark.sql import functions as F
from tallyforge.operators import board, rollup
from tallyforge.sources import landing, publish
from tallyforge.streaming import ledger as stream


def test_publishing_never_goes_back(spark, tmp_path):
    path, rows = str(tmp_path / "dash"), spark.createDataFrame([("a", 1)], "who string, n int")
    doc = lambda at: publish.as_document({"people": rows, "none": rows.limit(0)}, at)
    assert json.loads(doc(5).first().value) == {"generated_at": 5, "summary": {"people": [{"who": "a", "n": 1}], "none": []}}
    assert publish.publish(doc(5), path) and publish.published_at(spark, path) == 5
    assert not publish.publish(doc(5), path) and not publish.publish(doc(4), path) and publish.published_at(spark, path) == 5
    assert publish.publish(doc(6), path) and publish.published_at(spark, path) == 6
    assert not publish.publish(spark.createDataFrame([('{"generated_at": 9}',)], "value string"), path) and publish.published_at(spark, path) == 6


def snapshot(spark, at, n=1):
    return spark.createDataFrame([(json.dumps({"generated_at": at, "summary": {"n": n, "at": at}}),)], "value string")


def test_a_reader_always_finds_a_document_and_writers_cannot_go_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "doc")
    assert publish.document(spark, path) is None
    assert publish.publish(snapshot(spark, 1), path)
    stop, seen, failed = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(json.loads(publish.document(spark, path).first().value)["generated_at"])
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for at in (2, 3, 4, 5):
        assert publish.publish(snapshot(spark, at), path)
    stop.set()
    reader.join()
    assert not failed and seen == sorted(seen) and set(seen) <= {1, 2, 3, 4, 5}
    assert publish.versions(spark, path) == [3, 4, 5]
    # A writer that looked before the other had written.
    monkeypatch.setattr(publish, "published_at", lambda *_: 0)
    publish.publish(snapshot(spark, 2), path)
    monkeypatch.undo()
    assert publish.published_at(spark, path) == 5


def test_unchanged_documents_wait_for_the_heartbeat(spark, tmp_path):
    path, minute = str(tmp_path / "doc"), 60_000
    send = lambda at, n=1: publish.publish_if_changed(snapshot(spark, at * minute, n), path, ["n"])
    assert [send(1), send(2), send(3, 2), send(4, 2), send(22, 2), send(23, 2), send(24, 2), send(5, 9)] == [True, False, True, False, False, True, False, False]


def test_the_first_source_that_parses(spark, tmp_path):
    path, status = str(tmp_path / "copy"), str(tmp_path / "status")
    (tmp_path / "odd.json").write_text('{"generated_at": "soon"}')
    (tmp_path / "good.json").write_text(json.dumps({"generated_at": 7, "summary": {}}))
    (tmp_path / "old.json").write_text(json.dumps({"generated_at": 6, "summary": {}}))
    at = lambda *names: [str(tmp_path / f"{n}.json") for n in names]
    told = lambda: json.loads(publish.document(spark, status).first().value)
    assert publish.synchronised(spark, at("none", "odd", "good", "old"), path, status, 100) and publish.published_at(spark, path) == 7
    assert told() == {"checked_at": 100, "ok": True, "source": at("good")[0], "error": None, "synced_at": 100}
    assert not publish.synchronised(spark, at("old"), path, status, 200) and publish.published_at(spark, path) == 7
    assert not publish.synchronised(spark, at("none", "odd"), path, status, 300)
    assert told()["synced_at"] == 100 and not told()["ok"] and "no snapshot" in told()["error"] and "none.json" in told()["error"]


def test_parameters_and_configuration(spark, tmp_path):
    p = publish.report_parameters
    assert p("", "2024-01-05", "2024-03-07") == publish.Parameters("2024-03-01", "2024-03-07")
    assert p("#history?from=2024-02-09&to=2024-02-01&by=model&unit=week&metric=tokens", "2024-01-05", "2024-03-07") == publish.Parameters("2024-02-01", "2024-02-09", "model", "week", "tokens")
    assert p("#history?from=soon&by=evil&unit=year", "2024-03-03", "2024-03-07") == publish.Parameters("2024-03-03", "2024-03-07")
    (tmp_path / "c.json").write_text(json.dumps({"rules": [{"owner": "b", "host": "h"}, {"owner": "a"}]}))
    c = publish.read_config(spark, str(tmp_path / "c.json"), {"rules": "owner string, host string", "pins": "session_id string, owner string"})
    assert [tuple(r) for r in c["rules"].orderBy("pos").collect()] == [(0, "b", "h"), (1, "a", None)] and c["pins"].isEmpty()


def test_imported_records(spark, tmp_path):
    lines = [{"day": "2024-01-01", "provider": "p", "account": "a", "n": 1, "i": 5}, {"day": "2024-01-01", "provider": "p", "account": "a", "n": 2, "i": 7}, {"day": "2024-02-01", "provider": "p", "n": 1}]
    (tmp_path / "h.jsonl.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, lines)).encode()))
    out = rollup.imported_days(publish.day_records(spark, str(tmp_path / "h.jsonl.gz")), "2024-01-15", ["file", "line"]).collect()
    assert [(r.day, r.account, r.host, r.speed, r.lc, r.n, r.i, r.cw) for r in out] == [("2024-01-01", "a", "", "standard", 0, 2, 7, 0)]


def test_encoding(spark):
    d = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), (None, "y", 3)], "k string, m string, n int")
    rows, values = publish.encoded(d, ["k", "m"])
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 1, 3), (1, 0, 2), (2, 0, 1)]
    assert sorted((r.dim, r.code, r.value or "") for r in values.collect()) == [("k", 0, ""), ("k", 1, "a"), ("k", 2, "b"), ("m", 0, "x"), ("m", 1, "y")]


def test_encoding_of_numbers_and_texts(spark):
    d = spark.createDataFrame([("b", 10, 1), ("a", 9, 2), ("b", None, 3)], "k string, m int, n int")
    rows, values = publish.encoded(d, ["k", "m"])
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 1, 2), (1, 0, 3), (1, 2, 1)]
    assert sorted((r.dim, r.code, r.value or "") for r in values.collect()) == [("k", 0, "a"), ("k", 1, "b"), ("m", 0, ""), ("m", 1, "9"), ("m", 2, "10")]


def test_connectors_by_kind(spark):
    pages = spark.createDataFrame([("one", 1, "<p>1</p>"), ("two", 1, "<p>2</p>"), ("off", 1, ""), ("odd", 1, "")], "source string, page int, markup string")
    config = spark.createDataFrame([("one", "a", False, 0), ("two", "b", None, 1), ("off", "a", True, 2), ("odd", "z", False, 3), ("one", "b", False, 4)], "key string, kind string, disabled boolean, pos int")
    say = lambda name: lambda p, c: p.select("source", F.lit(name).alias("title"))
    assert sorted(tuple(r) for r in landing.collected(pages, config, {"a": say("A"), "b": say("B")}).collect()) == [("one", "B"), ("two", "B")]


def test_banner(spark):
    r = spark.createDataFrame([("A", True, True), ("B", True, None), ("C", False, True)], "label string, stale boolean, blocked boolean")
    assert tuple(board.collection_state(r, "2024-01-01 09:00", "2024-01-03").first()) == (True, ["A"], ["B"])
    assert not board.collection_state(r, "2024-01-02 09:00", "2024-01-03").first().late


def test_alerts_of_a_stream_spare_suspended_accounts(spark, tmp_path):
    rows = [("t", "p", "a", 0, 10, True), ("t", "p", "a", 60_000, 10, True), ("t", "p", "b", 0, 10, True), ("t", "p", "c", 0, 10, True), ("t", "p", "a", 900_000, 10, False)]
    d = spark.createDataFrame(rows, "name string, provider string, account string, ts long, cooldown_minutes int, breached boolean")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    accounts = spark.createDataFrame([("p", "a", "ok", False), ("p", "b", "suspended", False), ("p", "c", "ok", True)], "provider string, account string, status string, stale boolean")
    out = stream.sent_alerts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), accounts)
    out.writeStream.format("memory").queryName("alive").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.account, r.ts) for r in spark.table("alive").collect()] == [("a", 0)]
