import pytest
from pyspark.sql import functions as F

from colloq.operators import agency, formats


def test_lines(spark):
    rows = spark.createDataFrame([(1, i, "d", f"s{i}" if i else "", "me", "x", "a", "b", "t", "loc" if i else "", "slot") for i in range(7)],
                                 "g int, pos int, date string, subject string, sender string, snippet string, start string, end string, title string, location string, slot string")
    mail = formats.emails(rows, ["g"], "pos").first().context.split("\n")
    assert mail[:3] == ["ΠΡΟΣΦΑΤΑ EMAILS:", "- d: Χωρίς θέμα (από me) — x", "- d: s1 (από me) — x"] and len(mail) == 6
    day = formats.calendar(rows, ["g"], "pos").first().context.split("\n")
    assert day[1:3] == ["- a → b: t", "- a → b: t (loc)"] and len(formats.free_slots(rows, ["g"], "pos").first().context.split("\n")) == 6


def test_activity_news_weather(spark):
    payloads = [("PushEvent", '{"commits": [{"m": 1}, {"m": 2}]}'), ("PullRequestEvent", '{"action": "opened", "pull_request": {"title": "T"}}'), ("WatchEvent", None)]
    rows = spark.createDataFrame([(1, i, t, "r", "2026-01-02T10:00:00Z", p) for i, (t, p) in enumerate(payloads)], "g int, pos int, type string, repo string, created_at string, payload string")
    assert formats.commits(rows, ["g"], "pos").first().context.split("\n")[1:] == ["- 2/1/2026 [r] Push: 2 commit(s)", "- 2/1/2026 [r] PR: opened — T", "- 2/1/2026 [r] Watch"]
    rows = spark.createDataFrame([(1, 1, "T", "S", "d" * 200)], "g int, pos int, title string, source string, description string")
    assert formats.news(rows, ["g"], "pos").first().context == "ΕΙΔΗΣΕΙΣ:\n- [S] T: " + "d" * 100
    rows = spark.createDataFrame([('{"name": "Athens", "main": {"temp": 20.6, "feels_like": 19.2, "humidity": 40}, "weather": [{"description": "clear"}]}',), ("{}",)], "body string")
    out = [r.context for r in formats.weather(rows).collect()]
    assert "Θερμοκρασία: 21°C (αισθητή: 19°C)" in out[0] and out[1].endswith("Δεν βρέθηκαν δεδομένα καιρού.")


def test_frames_and_missing_sources(spark):
    f = spark.createDataFrame([("ctx",), (" ",)], "c string")
    assert [r[0] for r in f.select(formats.frame(F.col("c"), "H", "T")).collect()] == ["H\nctx\nT", ""]
    rows = spark.createDataFrame([("schedule", [("calendar", "failed")]), ("schedule", [("calendar", "ok")]), ("casual", [])], "i string, s array<struct<name:string,status:string>>")
    out = rows.select(formats.missing_instruction(F.col("i"), F.col("s"), {"schedule": "calendar"}, {"schedule": "no"}).alias("m")).collect()
    assert [r.m for r in out] == ["no", "", ""]


def test_signals_from_sources(spark):
    events = spark.createDataFrame([(1, "e1", "Meeting", "2026-08-24 09:00:00")], "g int, id string, summary string, starts_at string")
    mails = spark.createDataFrame([(1, "m1", "Reply", True), (1, "m2", "News", None)], "g int, id string, summary string, awaiting_reply boolean")
    waiting = spark.createDataFrame([(1, 4), (2, 0)], "g int, pending int")
    found = formats.signals(events, mails, waiting, ["g"])
    assert sorted((r.source, r.urgency) for r in found.collect()) == [("calendar", 3), ("conversation", 2), ("email", 2), ("email", 4)]
    now = F.lit("2026-08-24 08:00:00").cast("timestamp")
    assert agency.salience(found, ["g"], now).first().salience == pytest.approx(3 * 1.5 + 4 + 1 + 1)
    with pytest.raises(ValueError):
        formats.signals(None, None, None, ["g"])


@pytest.mark.parametrize(
    "text, issues, cleaned",
    [("Γράφω Rust. Και Python.", 1, "Και Python."), ("Είμαι 30 ετών", 1, "Είμαι 30 ετών"), ("Είμαι 26 ετών", 0, "Είμαι 26 ετών"), ("δουλεύω στη Microsoft", 1, "δουλεύω στη Microsoft"), ("δουλεύω στη nova", 0, "δουλεύω στη nova")],
)
def test_fact_check(spark, text, issues, cleaned):
    f = spark.createDataFrame([(text,)], "t string")
    r = f.select(formats.fact_check(F.col("t"), "python, sql", ["rust", "c++"], 26, ["nova"]).alias("c")).first().c
    assert (len(r.issues), r.cleaned, r.passed) == (issues, cleaned, issues == 0)
