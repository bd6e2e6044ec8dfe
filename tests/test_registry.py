"""Every registered query against its DuckDB equivalent at the smallest size."""

import math

import duckdb
import pytest

from colloq.plans import registry
from colloq.plans.flagship import masked_pairs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    key = lambda v: "nan" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(key, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    assert plain(tuple(r) for r in found.select(*columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = masked_pairs(spark, SF).collect()
    assert rows and all(r.n_pairs > 0 for r in rows)


def test_threads_use_one_shuffle(spark):
    plan = registry.QUERIES["session_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 1
