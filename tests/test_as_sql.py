"""Queries against their SQL on small tables whose letters and times the shared tables hardly have."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry


def same(spark, folder, query, **tables):
    """The rows of a query and of its SQL over tables given as (rows, schema)."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    found = entry.queries()[query](spark, str(folder))
    want = con.execute(f"select {', '.join(found.columns)} from ({entry.oracle_sql()[query]})").fetchall()
    rows = sorted(map(tuple, found.collect()), key=str)
    assert rows == sorted(want, key=str)
    return rows


TEXTS = ["straße strasse große grosse", "Thé sûndo station", "wort wort́er wörter wörterbuch", "ΟΔΟΣ οδος οδοσ ΟΔΟΣ οδος", "a b c d e f g a b c d e", "", None,
         "große straße führt zum bahnhof große strasse führt zum bahnhof", "Große Straße Bahnhof 18:30"]
CONTEXTS = ["die strasse und die grosse stadt", "die große straße führt zum bahnhof der stadt", "xa b c d ef g", "οδός οδος"]


@pytest.fixture
def odd():
    docs = [(i, TEXTS[i // len(CONTEXTS) % len(TEXTS)], "s", 10) for i in range(len(CONTEXTS) * len(TEXTS))]
    return {"documents": (docs, "doc_id long, text string, source string, n_chars long"), "benchmark": (list(enumerate(CONTEXTS)), "item_id long, text string")}


@pytest.mark.parametrize("query", ["grounding_score", "verbatim_overlap", "unsupported_specifics"])
def test_replies_against_contexts(spark, tmp_path, odd, query):
    assert len({r[1] for r in same(spark, tmp_path, query, **odd)}) > 2


@pytest.mark.parametrize("query", ["term_coverage", "ablation_report"])
def test_expected_terms(spark, tmp_path, query):
    docs = [(i, t, "s", 10) for i, t in enumerate(("Thé sûndo", "THE station", "und the Station", "", None))]
    same(spark, tmp_path, query, documents=(docs, "doc_id long, text string, source string, n_chars long"))


def test_session_gaps_in_whole_seconds(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 0, 0, 283370)
    gaps = [0, 14400_380092, 14400_000000, 14399_999999, 14401_000000, 14400_716629, 14400_716630, 60_000000]
    rows = []
    for i, gap in enumerate(gaps):
        at += datetime.timedelta(microseconds=gap)
        rows.append((i, at, 1))
    assert len(same(spark, tmp_path, "session_windows", events=(rows, "event_id long, ts timestamp_ntz, user_id long"))) == 4
