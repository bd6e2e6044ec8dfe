"""Streams with state against their batch forms, over several runs."""

import datetime

from colloq.operators import agency
from colloq.streaming import stateful

from pyspark.sql import functions as F

SIGNAL = "user string, pos long, ts timestamp, source string, key string, summary string, urgency int, occurs_at timestamp, detail string"
T0 = datetime.datetime(2024, 1, 1)


def now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


def signal(user, pos, day, summary, urgency, key=""):
    return (user, pos, T0 + datetime.timedelta(days=day), "email", key, summary, urgency, None, "")


def test_suppression_and_weighing_over_runs(spark, tmp_path):
    runs = [
        [signal("a", 1, 0, "Meeting", 4), signal("a", 2, 0, " mééting ", 1), signal("b", 3, 0, "news", 1), signal("c", 4, 0, "x", 3), signal("c", 5, 0, "y", 1)],
        [signal("a", 6, 1, "meeting", 4), signal("a", 7, 1, "news", 2), signal("b", 8, 1, "news", 1), signal("b", 9, 1, "bill", 3), signal("d", 10, 1, "", 4, key="k1")],
        [signal("a", 11, 2, "news", 2), signal("b", 12, 2, "bill", 3), signal("c", 13, 2, "x", 3), signal("c", 14, 2, "z", 4), signal("d", 15, 2, "other", 3, key="k1")],
    ]
    said, want = None, []
    for k, rows in enumerate(runs):
        batch = spark.createDataFrame(rows, SIGNAL)
        spoken = agency.should_speak(batch, ["user"], "pos", now(), said)
        want += [(r.user, round(r.salience, 9), r.n, r.speaks) for r in spoken.collect()]
        fresh = agency.dedupe(batch, ["user"], "pos", said).join(spoken.filter("speaks").select("user"), "user", "left_semi").select("user", "identity")
        fresh = spark.createDataFrame(fresh.collect(), "user string, identity string")
        said = fresh if said is None else said.union(fresh)
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.speak_or_wait(stateful.lots(spark, SIGNAL, str(tmp_path / "in")), "user", "pos", "ts", now())
        stateful.run(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))  # each run goes on from the one before
    found = [(r.user, round(r.salience, 9), r.n, r.speaks, r.body) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    silent = [(u, s, n) for u, s, n, _, _ in found if n == 0]  # all was said before: the batch form has no row for it
    assert sorted(x[:4] for x in found if x[2]) == sorted(want) and len(silent) == 2
    assert ("c", 4.0, 1, True, "! z") in found and ("b", 3.5, 2, True, "⏱ bill\n→ news") in found


def test_what_was_said_is_forgotten_and_state_goes(spark, tmp_path):
    for k, day in enumerate((0, 3, 30, 60)):
        rows = [signal("a", k, day, "same", 4)] if k != 3 else [signal("z", k, day, "late user", 1)]
        spark.createDataFrame(rows, SIGNAL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.speak_or_wait(stateful.lots(spark, SIGNAL, str(tmp_path / "in")), "user", "pos", "ts", now(), remember_hours=24 * 7)
        seen = stateful.run(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = spark.read.parquet(str(tmp_path / "out")).filter("user = 'a'").orderBy("n").collect()
    assert sorted((r.n, r.speaks) for r in found) == [(0, False), (1, True), (1, True)]  # said, suppressed, said again
    assert seen["state"] == 0


def test_sessions_close_and_leave_the_state(spark, tmp_path):
    schema = "chat string, ts timestamp, id long"
    at = lambda day, hour: T0 + datetime.timedelta(days=day, hours=hour)
    days = [[(f"c{c}", at(d, h), d * 100 + c * 10 + h) for c in range(5) for h in (1, 2, 9)] for d in range(6)]
    late = [("c0", at(0, 2.5), 900), ("c9", at(1, 5), 901)]  # days after the watermark has passed them
    most, n_late = [], 0
    for k, rows in enumerate(days):
        spark.createDataFrame(rows + (late if k == 5 else []), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.closed_sessions(stateful.lots(spark, schema, str(tmp_path / "in")), "chat", "ts", 240, "1 day")
        seen = stateful.run(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        most.append(seen["most"])
        n_late += seen["late"]
    found = sorted((r.chat, r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    edge = at(5, 9) - datetime.timedelta(days=1)
    want = sorted((f"c{c}", at(d, h), n) for c in range(5) for d in range(6) for h, n in ((1, 2), (9, 1)) if at(d, h + 5 if n == 2 else h + 4) <= edge)
    assert found == want and n_late == len(late)
    assert max(most) <= 40  # two days of sessions, not all of them


def test_lots_are_not_one_task_each(spark, tmp_path, monkeypatch):
    """The lots of closed sessions are written and read by as many tasks as there are (F16)."""
    from colloq.plans import round_trips

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    paths = {}
    monkeypatch.setattr(round_trips, "scratch", lambda s, tag: paths.setdefault(tag, str(tmp_path / tag)))
    found = round_trips.stream_closed_sessions(spark, str(tmp_path))
    assert len(list((tmp_path / "closed-in").glob("*.parquet"))) > 4
    assert found.count() > 0
