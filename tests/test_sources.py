import json
import mailbox
import sqlite3

import pytest
from pyspark.sql import functions as F

from colloq.operators.medallion import reply_pairs
from colloq.sources import files, messages, sinks
from colloq.streaming import streams


def test_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿Date,Sender,Message,Chat\n25/12/2025 10:30:00,Me,"hello, you",c1\ngarbage,Bob,hi,\n25/12/2025 10:30:00,Bob,  ,c1\n', encoding="utf-8")
    rows = sorted(tuple(r) for r in messages.read_csv(spark, str(path), "Me").collect())
    assert rows == [("2025-12-25T10:30:00Z", "c1", "Me", True, "hello, you"), ("garbage", "unknown", "Bob", False, "hi")]


@pytest.mark.parametrize("wrap", [True, False])
def test_json(spark, tmp_path, wrap):
    rows = [{"when": "2026-01-01 10:00:00", "who": "me", "body": "yes", "room": "r"}, {"when": "x", "who": None, "body": ""}]
    (tmp_path / "m.json").write_text(json.dumps({"messages": rows} if wrap else rows))
    mapping = {"timestamp": "when", "sender": "who", "text": "body", "chat_id": "room"}
    assert [tuple(r) for r in messages.read_json(spark, str(tmp_path / "m.json"), "me", mapping).collect()] == [("2026-01-01T10:00:00Z", "r", "me", True, "yes")]


def test_pairs_corpus_terms(spark, tmp_path):
    rows = [{"instruction": "a", "response": "b"}, {"instruction": "", "response": "b"}, {"response": "only"}, {"instruction": "c", "response": "d"}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    found = messages.read_pairs(spark, str(tmp_path / "p.json"))
    assert tuple(messages.invalid_pairs(found).first()) == (4, 2)
    assert [r.text for r in messages.read_corpus(spark, str(tmp_path / "p.json"), 1).collect()] == ["a\nb"]
    (tmp_path / "t.txt").write_text("# names\nΑ\n\n Β \n")
    assert [r.term for r in messages.read_terms(spark, str(tmp_path / "t.txt")).collect()] == ["Α", "Β"]


def test_feedback_log(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"message": "m", "rating": 1}\nnot json\n')
    assert messages.read_feedback(spark, str(tmp_path / "f.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception):
        messages.read_feedback(spark, str(tmp_path / "f.jsonl"), strict=True).collect()


def test_configuration():
    tree = {"a": {"b": 1, "never": [2]}, "c": ["x"]}
    assert messages.lookup(tree, "a.b") == 1 and messages.lookup(tree, "a.z", 7) == 7
    assert messages.without_keys(tree, {"never"}) == {"a": {"b": 1}, "c": ["x"]}
    assert messages.flatten(tree)[:2] == ["a:", "  b: 1"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("create table messages(timestamp, body, chat_id, is_outgoing, sender_id)")
        db.execute("create table contacts(id, name)")
        db.executemany("insert into messages values (?,?,?,?,?)", [(1767261600000, "b", "c", 0, 1), (1767261500, "a", "c", 1, 9), (3, " ", "c", 0, 1)])
        db.execute("insert into contacts values (1, 'Ann')")
    files.register(spark)
    rows = spark.read.format("sqlite_messages").load(path).collect()
    assert [(r.sender, r.is_me, r.text) for r in rows] == [("me", True, "a"), ("Ann", False, "b")]


def test_mbox_reply_pairs(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "m.mbox"))
    for head, body in (("From: x@y\nMessage-ID: <1>", "question"), ("From: Me <me@z>\nMessage-ID: <2>\nIn-Reply-To: <1>\nDate: d", "answer"), ("From: me@z\nMessage-ID: <3>\nIn-Reply-To: <2>", "to myself")):
        box.add(f"{head}\n\n{body}")
    box.close()
    files.register(spark)
    pairs = reply_pairs(spark.read.format("mbox").load(str(tmp_path / "m.mbox")), ["me@z"]).collect()
    assert [(p.instruction.strip(), p.response.strip(), p.source) for p in pairs] == [("question", "answer", "email")]


def test_sinks(spark, tmp_path):
    f = spark.range(5)
    assert sinks.write_jsonl(f, str(tmp_path / "out")) == 5
    with pytest.raises(ValueError):
        sinks.export(f, str(tmp_path / "out"), str(tmp_path / "out") + "/")
    sinks.log(f, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 10
    sinks.ensure_schema(spark, "silver_test")
    sinks.replace(f, "silver_test.t")
    sinks.append(f, "silver_test.t")
    assert spark.table("silver_test.t").count() == 10


def test_ingest_stream_is_exactly_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"timestamp": "t", "chat_id": "c", "sender": "s", "is_me": true, "text": "x"}\n'
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.json").write_text(line * n)
        streams.ingest(streams.message_stream(spark, str(tmp_path / "in")), str(tmp_path / "bronze"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 3


def run_to_memory(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [("u1", f"2024-01-01 {h:02d}:00:00") for h in (1, 2, 8, 23)] + [("u2", "2024-01-01 03:00:00"), ("u2", "2024-01-09 03:00:00")]
    events = spark.createDataFrame(rows, "u string, t string").select("u", F.col("t").cast("timestamp").alias("ts"))
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, ts timestamp").json(str(tmp_path / "in"))
    run_to_memory(streams.session_stream(stream, "u", "ts"), "sessions", "append")
    closed = {(r.u, r.n) for r in spark.table("sessions").collect()}
    assert closed == {("u1", 2), ("u1", 1), ("u2", 1)}
    run_to_memory(streams.window_counts(stream, "ts", "6 hours"), "tumbling", "update")
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == 6


def test_suppression_and_backlog_streams(spark, tmp_path):
    rows = [("email", "", "Same  summary", "2024-01-01 01:00:00"), ("email", "", "same summary", "2024-01-01 02:00:00"), ("email", "k", "same summary", "2024-01-01 03:00:00")]
    f = spark.createDataFrame(rows, "source string, key string, summary string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    f.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).json(str(tmp_path / "in"))
    run_to_memory(streams.fresh_signals(stream, "ts"), "fresh", "append")
    assert spark.table("fresh").count() == 2
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"rating": -1}\n{"rating": 1, "correction": "c"}\n{"rating": 1}\n')
    run_to_memory(streams.pending_count(spark, str(tmp_path / "log")), "pending", "complete")
    assert tuple(spark.table("pending").first()) == (2, 3)


def test_corpus_must_be_a_list(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"instruction": "a", "response": "b"}))
    with pytest.raises(ValueError, match="JSON list"):
        messages.read_corpus(spark, str(tmp_path / "p.json"))
    rows = [{"instruction": "a"}, {"instruction": "a", "instruction_clean": "x", "response": "b"}, {"instruction": "c", "response": ""}, {"instruction": "e", "response": "f"}]
    (tmp_path / "q.json").write_text("\n " + json.dumps(rows))
    found = messages.read_corpus(spark, str(tmp_path / "q.json")).collect()
    assert [(r.metadata["index"], r.doc_id, r.text) for r in found] == [(1, "pair_1", "x\nb"), (3, "pair_3", "e\nf")]


def test_config_and_gazetteer(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("a:\n  b: [1, x]\n")
    assert messages.lookup(messages.read_config(str(tmp_path / "c.yaml")), "a.b") == [1, "x"]
    (tmp_path / "one.txt").write_text("# c\nΠαπά\n\nΆλφα\n")
    (tmp_path / "two.txt").write_text("βήτα\n")
    assert messages.read_gazetteer([None, str(tmp_path / "none"), str(tmp_path / "one.txt")]) == ("αλφα", "παπα")
    monkeypatch.setenv("NAMES_FILE", str(tmp_path / "two.txt"))
    assert messages.read_gazetteer([str(tmp_path / "one.txt")], "NAMES_FILE") == ("βητα",)
    assert messages.gazetteer_status(messages.read_gazetteer([])).startswith("no surname gazetteer")
    assert messages.gazetteer_status(("α",)).startswith("1 ")


def test_jsonl_and_fields(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"timestamp": "t", "chat_id": "c", "sender": "s", "is_me": true, "text": "x"}\n{"text": null}\n')
    rows = messages.read_jsonl(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == 2 and rows.columns == ["timestamp", "chat_id", "sender", "is_me", "text"]
    assert sorted(r.text for r in messages.read_fields(rows, ["text", "sender"]).collect()) == ["", "", "s", "x"]


def test_json_array_log_and_history(spark, tmp_path):
    rows = spark.range(0, 50, 1, 4).selectExpr("id", "if(id = 3, null, concat('a\"', id)) as t")
    sinks.write_json_array(rows, f"{tmp_path}/a")
    (part,) = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part")]
    assert json.loads(part.read_text()) == [{"id": i, "t": None if i == 3 else f'a"{i}'} for i in range(50)]
    sinks.write_json_array(rows.orderBy(F.desc("id")).select("id"), f"{tmp_path}/c")
    (part,) = [p for p in (tmp_path / "c").iterdir() if p.name.startswith("part")]
    assert [x["id"] for x in json.loads(part.read_text())] == list(range(49, -1, -1))
    sinks.write_json_array(rows.limit(0), f"{tmp_path}/b")
    assert json.loads(next(p for p in (tmp_path / "b").iterdir() if p.name.startswith("part")).read_text()) == []
    assert sinks.log(rows, f"{tmp_path}/log") == 50 and sinks.log(rows.limit(2), f"{tmp_path}/log") == 52
    sinks.append_history(rows.filter("id = 7"), f"{tmp_path}/h")
    assert [(r.entry, r.id) for r in sinks.append_history(rows.filter("id = 9"), f"{tmp_path}/h").collect()] == [(0, 7), (1, 9)]


def test_table_from_a_query(spark):
    for n in (1, 2):
        sinks.create_as(spark, "made_from_a_query", f"with a as (select {n} as x), b as (select x + 1 as y from a) select y from b")
        assert [r.y for r in spark.table("made_from_a_query").collect()] == [n + 1]
