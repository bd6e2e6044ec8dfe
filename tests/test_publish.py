"""Checked publication and tables by day."""

import json
import os
from pathlib import Path

import pytest

from colloq.operators import increments, privacy
from colloq.sources import publish, sinks

from pyspark.sql import functions as F


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_the_files_are_scanned_not_the_plan(spark, tmp_path):
    """A text that is clean when it is scanned as a plan, and is not when it is written, does not get through."""
    flip = tmp_path / "flip"
    flip.write_text("")

    @F.udf("string")
    def unsteady(t):
        n = len(flip.read_text())
        flip.write_text("x" * (n + 1))
        return "ok" if n == 0 else "Παπαδοπουλοσ"

    rows = spark.range(1).select(unsteady.asNondeterministic()(F.lit("t")).alias("text"))
    check = lambda f: privacy.gate(f.filter("text <> 'ok'"), "names remain")
    assert rows.filter("text <> 'ok'").isEmpty()  # the plan's first run is clean
    with pytest.raises(ValueError):
        publish.publish(rows, str(tmp_path / "out"), check)
    assert sorted(os.listdir(tmp_path)) == ["flip"]
    good = spark.range(3)
    publish.publish(good, str(tmp_path / "out"), lambda f: privacy.gate(f.filter("id > 5")))
    with pytest.raises(FileExistsError):
        publish.publish(good, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        publish.publish(good, str(tmp_path / "out"), privacy.gate, replace=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    publish.publish(spark.range(5), str(tmp_path / "out"), replace=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and sorted(os.listdir(tmp_path)) == ["flip", "out"]


def test_sources_are_refused(spark, tmp_path):
    spark.range(4).write.json(f"{tmp_path}/a")
    rows = spark.read.schema("id long").json(f"{tmp_path}/a")
    for path in (f"{tmp_path}/a", f"file://{tmp_path}/a/", f"{tmp_path}"):
        with pytest.raises(ValueError):
            publish.write_json_array(rows, path)
        with pytest.raises(ValueError):
            sinks.export(rows, f"{tmp_path}/a", path)
    assert rows.count() == 4
    publish.write_json_array(rows, f"{tmp_path}/ab")


def test_json_array_of_many_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.lit("é,[]\n")).alias("t"))
    publish.write_json_array(rows, f"{tmp_path}/out", files=5)
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    whole = json.loads("".join((tmp_path / "out" / p).read_text() for p in parts))
    assert [r["id"] for r in whole] == list(range(1000)) and whole[0]["t"] is None and len(parts) > 1
    publish.write_json_array(rows.limit(0), f"{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part*")))) == []


MESSAGE = "timestamp string, chat_id string, sender string, is_me boolean, text string"


def test_a_batch_rewrites_the_days_it_touches(spark, tmp_path):
    first = [(f"2024-01-0{d} {h}:00:00", "c", "me" if h % 2 else "you", bool(h % 2), f"text {h}") for d in (1, 2, 3, 4) for h in (10, 11, 22, 23)]
    second = [("2024-01-03 12:00:00", "c", "you", False, "new"), ("2024-01-03 12:30:00", "c", "me", True, "answer"), ("2024-01-03 10:00:00", "c", "you", False, "text 10"), ("never", "c", "you", False, "no time")]
    third = [("2024-01-03 01:00:00", "c", "me", True, "late answer"), ("2024-01-01 10:30:00", "c", "you", False, "between"), ("2024-01-01 22:30:00", "c", "me", False, "between")]
    frame = lambda rows: spark.createDataFrame(rows, MESSAGE)
    days = increments.Days(spark, str(tmp_path / "t"))
    days.add(frame(first))
    before = files(tmp_path / "t/clean") | files(tmp_path / "t/pairs")
    own, paired = days.add(frame(second))
    assert [str(d) for d in own] == [str(d) for d in paired] == ["2024-01-03"]
    after = files(tmp_path / "t/clean") | files(tmp_path / "t/pairs")
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert changed and all("day=2024-01-03" in p for p in changed)
    assert [str(d) for d in days.add(frame(third))[1]] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert days.add(frame(first).limit(0)) == ([], [])
    once = increments.Days(spark, str(tmp_path / "once"))
    once.add(frame(first + second + third))
    for name, columns in (("clean", ["ts", "chat_id", "sender", "text", "is_me"]), ("pairs", ["ts", "text", "response", "response_ts"])):
        rows = [sorted(map(tuple, d.table(name).select(*columns).collect())) for d in (days, once)]
        assert rows[0] == rows[1] and rows[0]
    texts = {(r.text, r.response) for r in days.table("pairs").collect()}
    assert ("new", "answer") in texts and ("text 22", "late answer") not in texts


def test_a_day_is_not_a_file_from_every_task(spark, tmp_path):
    """A day's rows meet before they are written, in the table they come to and in those made of it (F12)."""
    from colloq.operators.increments import Days

    rows = [(f"2024-05-{1 + i % 3:02d} 10:{i % 60:02d}:00", f"c{i % 5}", f"s{i}", i % 2 == 0, f"text {i}") for i in range(240)]
    days = Days(spark, str(tmp_path / "days"))
    days.add(spark.createDataFrame(rows, "timestamp string, chat_id string, sender string, is_me boolean, text string").repartition(6))
    for name in ("bronze", "clean", "pairs"):
        files = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "days" / name).glob("day=*")]
        assert files == [1, 1, 1], name
    assert days.table("bronze").count() == 240
