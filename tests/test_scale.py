"""Operators that no hot key can hold up, against their plain forms."""

import datetime
import math
import random

import pytest

from colloq.operators import medallion, metrics, quantiles, sessions

from pyspark.sql import functions as F

T0 = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def chats(spark):
    """One chat has 90 % of the rows; gaps around the limit; many rows of equal time."""
    rng, rows, at = random.Random(3), [], dict.fromkeys("abc", T0)
    for i in range(4000):
        chat = "a" if rng.random() < 0.9 else rng.choice(["b", "c", None])
        at[chat] = at.get(chat, T0) + datetime.timedelta(minutes=rng.choice([0, 0, 0, 1, 30, 239, 240, 241, 600]), microseconds=rng.choice([0, 1, 999_999]))
        rows.append((chat, at[chat], i % 50, rng.random() < 0.4, rng.choice(["x", "hello", "fine thanks"])))
    return spark.createDataFrame(rows, "chat string, ts timestamp_ntz, tie int, me boolean, text string")


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("run_rows", [37, 500, 10_000])
def test_threads_by_prefix_scan(chats, run_rows):
    found = sessions.threads_scan(chats, "chat", "ts", "tie", run_rows=run_rows)
    want = medallion.threads(chats, "chat", "ts", "tie")
    assert found.columns == want.columns and tuples(found) == tuples(want)


def test_no_task_reads_a_hot_chat(spark, chats):
    """Sessions' runs: of 3,600 rows of one chat, none has more than a few times the aim."""
    sizes = []
    keep = sessions.written

    def counting(df, tag):
        out = keep(df, tag)
        if tag == "runs":
            sizes.extend(r["count"] for r in out.groupBy("chat", "_run").count().collect())
        return out

    sessions.written = counting
    try:
        sessions.threads_scan(chats, "chat", "ts", "tie", run_rows=100).count()
    finally:
        sessions.written = keep
    assert len(sizes) > 20 and max(sizes) <= 300


def test_threads_scan_edges(spark, chats):
    empty = chats.limit(0)
    assert sessions.threads_scan(empty, "chat", "ts", "tie", run_rows=5).count() == 0
    same = chats.select(F.lit(None).cast("string").alias("chat"), F.lit(T0).cast("timestamp_ntz").alias("ts"), "tie", "me", "text")
    assert {r.thread_id for r in sessions.threads_scan(same, "chat", "ts", "tie", run_rows=50).collect()} == {1}


@pytest.mark.parametrize("run_rows", [41, 10_000])
def test_pairs_by_scan(chats, run_rows):
    rows = chats.withColumn("order", F.struct("tie", "me", "text"))
    found = sessions.pairs_scan(rows, "chat", "ts", "order", F.col("me"), "text", run_rows=run_rows)
    threaded = medallion.threads(rows, "chat", "ts", "order")
    want = medallion.pairs(threaded, ["chat", "thread_id"], ["ts", "order"], F.col("me"), "text", "ts")
    columns = ["chat", "ts", "tie", "text", "response", "response_ts"]
    assert tuples(found.select(*columns)) == tuples(want.select(*columns)) and found.count() > 100


@pytest.mark.parametrize("sort_rows,buckets", [(5, 3), (50, 1024), (100_000, 1024)])
def test_exact_quantiles(spark, sort_rows, buckets, monkeypatch):
    rng = random.Random(sort_rows)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e300, 5e-324 * rng.randint(0, 3), 7.0])) for _ in range(900)]
    rows += [("same", 2.5)] * 300 + [("few", 1.0), ("few", 2.0), (None, 3.0), ("none", None), ("hot", None)]
    rows += [("ends", x) for x in [-math.inf] * 40 + [math.inf] * 30 + [0.0, -0.0, 1.0, 2.0] * 5]
    frame = spark.createDataFrame(rows, "k string, v double")
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    ranks = lambda n: {f"r{q}": F.greatest(F.ceil(n * F.lit(q / 100)), F.lit(1)) for q in (0, 1, 50, 95, 100)}
    found = {(r.k, r.which): r.found for r in quantiles.ranked_values(frame, "v", ["k"], ranks, sort_rows, buckets).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    want = {(k, f"r{q}"): sorted(vs)[max(math.ceil(len(vs) * (q / 100)), 1) - 1] for k, vs in by.items() for q in (0, 1, 50, 95, 100)}
    assert found == want
    finite = frame.filter("k is null or k <> 'ends'").filter("v is null or abs(v) < 1e200")
    a, b = quantiles.latency(finite, "v", ["k"], sort_rows).collect(), metrics.latency(finite, "v", ["k"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    whole = quantiles.latency(finite, "v", (), sort_rows).first()
    assert whole[1:] == metrics.latency(finite, "v").first()[1:]
    assert quantiles.latency(frame.limit(0), "v", ["k"], sort_rows).count() == 0


def test_index_reads_texts_once_and_grows(spark, tmp_path):
    from colloq.operators import search

    texts = ["a b b c", "", None, "b é b", "C c c d", "zz a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.id: (r.dl, dict(zip(r.terms, r.tfs))) for r in search.counted(docs).collect()}
    assert rows == {0: (4, {"a": 1, "b": 2, "c": 1}), 1: (0, {}), 2: (0, {}), 3: (2, {"b": 2}), 4: (4, {"c": 3, "d": 1}), 5: (2, {"zz": 1, "a": 1})}
    asked = spark.createDataFrame([(1, "b c"), (2, "a a zz")], "query_id long, query string")
    terms = search.query_terms(asked, "query_id", "query")
    whole = search.build_index(docs)
    for lot in (0, 1):
        search.build_index(docs.filter(F.col("doc_id") % 2 == lot)).save(str(tmp_path / "index"), str(lot))
    stored = search.Index.load(spark, str(tmp_path / "index"), terms)
    want = tuples(search.scores(whole, terms))
    got = tuples(search.scores(stored, terms))
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want))
    assert tuples(stored.terms.select("term", "df")) == tuples(whole.terms.select("term", "df"))
    plan = search.scores(search.build_index(docs, terms=terms), terms)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.split("query")[0] and "PartitionFilters: [bucket" in stored.postings._jdf.queryExecution().executedPlan().toString()


def test_row_numbers(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, None if i % 50 == 0 else i) for i in range(1000)], "a long, b long")
    found = sessions.row_numbers(rows, ["a"], "k", parts=7).collect()
    assert sorted(r.k for r in found) == list(range(1000)) and all(r.k == r.a for r in found)
    assert sessions.row_numbers(rows.limit(0), ["a"], "k").count() == 0
