"""Queries over the shop's tables, whose keys are skewed: operators that no hot key can hold up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import increments, near_names, quantiles, sessions, set_join, vector_index
from ..session import scratch, table
from ..sources import trees
from .catalog import query, r6

#: Rows of a run and of a sort, small, so that the tables' hot keys are split at every size.
RUN, SORT = 300, 300

_CLICKS = """with g as (select *, lag(ts) over w as prev from clicks where ts is not null window w as (partition by client_id order by ts)),
t as (select *, sum(case when prev is null or floor(epoch(ts)) - floor(epoch(prev)) > 14400 then 1 else 0 end)
    over (partition by client_id order by ts)::bigint as thread_id from g)"""


def _clicks(spark, sf):
    rows = table(spark, sf, "clicks").filter("ts is not null")
    return rows.withColumn("tie", F.struct("click_id", "kind", "value", "arrived_at"))


@query(f"{_CLICKS} select client_id, thread_id, min(ts) as start, max(ts) as last, count(*)::bigint as n from t group by client_id, thread_id")
def click_threads(spark, sf):
    threaded = sessions.threads_scan(_clicks(spark, sf), "client_id", "ts", "tie", run_rows=RUN)
    return sessions.sessions_of(threaded, "client_id", "ts")


@query("""with p as (select client_id, click_id, ts, kind, lead(kind) over w as response, lead(ts) over w as response_ts from clicks where ts is not null
window w as (partition by client_id order by ts, click_id, kind nulls first, value nulls first, arrived_at))
select * from p where coalesce(kind, '') not in ('purchase', 'signup') and response in ('purchase', 'signup') and length(kind) >= 2
and floor(epoch(response_ts)) - floor(epoch(ts)) <= 14400""")
def click_pairs(spark, sf):
    mine = F.coalesce(F.col("kind").isin("purchase", "signup"), F.lit(False))
    found = sessions.pairs_scan(_clicks(spark, sf), "client_id", "ts", "tie", mine, "kind", run_rows=RUN)
    return found.select("client_id", "click_id", "ts", "kind", "response", "response_ts")


def _quantiles_sql(t: str, key: str, value: str) -> str:
    return (f"select {key}, round(avg({value}), 6) as mean_s, round(median({value}), 6) as median_s, "
            f"round(quantile_disc({value}, 0.95), 6) as p95_s, count({value})::bigint as n from {t} group by {key}")  # fmt: skip


def _quantiles(rows, value: str, key: str):
    p = quantiles.latency(rows, value, [key], SORT)
    return p.select(key, *(r6(F.col(c)).alias(c) for c in ("mean_s", "median_s", "p95_s")), "n")


@query(_quantiles_sql("clicks", "kind", "value"))
def click_value_quantiles(spark, sf):
    return _quantiles(table(spark, sf, "clicks"), "value", "kind")


@query(_quantiles_sql("sale_lines", "vendor_id", "amount"))
def vendor_amount_quantiles(spark, sf):
    return _quantiles(table(spark, sf, "sale_lines"), "amount", "vendor_id")


@query(None)  # edits of all pairs are too slow in SQL
def near_name_candidates(spark, sf):
    """Pairs of tokens and names that few enough deletions and insertions part."""
    tokens = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\w.-]+"), 0)).alias("token")).filter("length(token) >= 5").distinct()
    names = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{11,}"), 0)).alias("name")).distinct()
    some = tokens.join(names.withColumnRenamed("name", "token"), "token", "left_anti")
    return near_names.candidates(some, names).select("token", "name", F.col("edits").cast("long").alias("edits"))


@query("""with w as materialized (select doc_id as id, list_distinct(regexp_extract_all(replace(lower(text), 'ς', 'σ'), '[\\p{L}\\p{M}\\p{Nd}_]+')) as w from documents),
u as (select id, unnest(w) as x, len(w) as n from w),
p as (select a.id as id_a, b.id as id_b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from u a join u b using (x) where a.id < b.id group by 1, 2)
select id_a, id_b, round(shared / (na + nb - shared), 6) as jaccard from p where shared / (na + nb - shared) >= 0.5 - 1e-9""")
def similar_documents(spark, sf):
    """Documents whose words are alike by half or more."""
    found = set_join.similar_pairs(table(spark, sf, "documents"), "doc_id", T.words(F.col("text")), 0.5)
    return found.select("id_a", "id_b", r6(F.col("jaccard")).alias("jaccard"))


@query("""with m as (select distinct ts, client_id, kind from clicks where ts is not null and trim(kind) <> ''),
p as (select client_id::varchar as chat_id, ts, kind as text, lead(kind) over w as response, lead(ts) over w as response_ts from m window w as (partition by client_id order by ts, kind))
select * from p where text not in ('purchase', 'signup') and response in ('purchase', 'signup') and length(text) >= 2 and floor(epoch(response_ts)) - floor(epoch(ts)) <= 14400""")
def incremental_pairs(spark, sf):
    """Clicks in three lots by their arrival, each lot rewriting the days that it touches; the whole result is that of one run."""
    rows = table(spark, sf, "clicks").select(
        F.col("ts").cast("string").alias("timestamp"), F.col("client_id").cast("string").alias("chat_id"), F.col("client_id").cast("string").alias("sender"),
        F.coalesce(F.col("kind").isin("purchase", "signup"), F.lit(False)).alias("is_me"), F.col("kind").alias("text"), F.month("arrived_at").alias("lot"))
    days = increments.Days(spark, scratch(spark, "days"))
    for lot in (F.col("lot") <= 2, F.col("lot") == 3, F.coalesce(F.col("lot"), F.lit(9)) >= 4):
        days.add(rows.filter(lot).drop("lot"))
    found = days.table("pairs")
    return found.select("chat_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "text", "response", F.col("response_ts").cast("timestamp_ntz").alias("response_ts"))


@query("""with recursive t(v, path, depth) as (
select json(props), '$', 0 from clicks where props is not null and json_valid(props) union all
select e.value, t.path || case json_type(t.v) when 'OBJECT' then '.' || e.key else '[' || e.key || ']' end, depth + 1
from t, json_each(t.v) e where json_type(t.v) in ('OBJECT', 'ARRAY') and not (json_type(t.v) = 'OBJECT' and e.key in ('tags', 'ver')))
select path, depth, case json_type(v) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' else 'leaf' end as kind,
case when json_type(v) not in ('OBJECT', 'ARRAY', 'NULL') then v->>'$' end as value, count(*)::bigint as n from t group by all""")
def click_props_tree(spark, sf):
    """Every node of the clicks' nested properties but two dropped members, counted by path and value."""
    found = trees.nodes(table(spark, sf, "clicks"), ["click_id"], "props", drop=("tags", "ver"))
    return found.groupBy("path", "depth", "kind", "value").agg(F.count("*").alias("n"))


@query("""select click_id, coalesce(case when json_valid(props) then props->>'$.device.os' end, 'unknown') as os, case when json_valid(props) then props->>'$.items[0].sku' end as sku from clicks""")
def click_props_lookup(spark, sf):
    os = trees.lookup("props", "device.os", "unknown")
    sku = F.try_variant_get(F.try_parse_json("props"), "$.items[0].sku", "string")
    return table(spark, sf, "clicks").select("click_id", os.alias("os"), sku.alias("sku"))


@query("""with v as materialized (select vec_id, embedding::double[] as e from embeddings where embedding is not null and list_dot_product(embedding::double[], embedding::double[]) > 0),
s as (select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.e, v.e), 9) as score from v, v q where q.vec_id % 10 = 0)
select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, id)::int as rank from s qualify rank <= 5""")
def vector_batch_topk(spark, sf):
    """Every tenth vector asks all vectors."""
    rows = table(spark, sf, "embeddings")
    index = vector_index.build(rows, "vec_id", "embedding")
    found = vector_index.search(index, rows.filter("vec_id % 10 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "id", r6(F.col("score")).alias("score"), "rank")
