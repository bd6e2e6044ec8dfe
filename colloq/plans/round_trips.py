"""Queries that write a table through a sink or in a source's format and read it again, and streams run to their end."""

from __future__ import annotations

import atexit
import mailbox
import os
import sqlite3
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import medallion
from ..session import scratch, table
from ..sources import files, messages, sinks
from ..streaming import stateful, streams
from .catalog import long, query

_STAMP = "timestamp '2024-01-01 10:00:00' + to_minutes(turn::int)"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as exported messages, a minute a turn; every seventh turn is blank."""
    at = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    return table(spark, sf, "conversations").select(
        F.date_format(at, "dd/MM/yyyy HH:mm:ss").alias("timestamp"), F.col("conv_id").cast("string").alias("chat_id"), F.col("role").alias("sender"),
        (F.col("role") == "assistant").alias("is_me"), F.when(F.col("turn") % 7 == 6, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"))


def _local(spark: SparkSession, tag: str) -> str:
    """A scratch path as file libraries take it: the shared folder must be mounted on every node."""
    url = urlparse(scratch(spark, tag))
    if url.scheme not in ("", "file"):
        raise RuntimeError("file libraries need a shared folder that is mounted")
    os.makedirs(os.path.dirname(url.path), exist_ok=True)
    return url.path


# Sources --------------------------------------------------------------------------------------


@query(f"""select strftime({_STAMP}, '%d/%m/%Y %H:%M:%S') as "timestamp", conv_id::varchar as chat_id, role as sender, role = 'assistant' as is_me,
case when turn % 7 = 6 then '  ' else ' ' || text end as text, true as stamped from conversations""")
def jsonl_messages(spark, sf):
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(_messages(spark, sf), path)
    return medallion.bronze(messages.read_jsonl(spark, path)).select("timestamp", "chat_id", "sender", "is_me", "text", F.col("_ingested_at").isNotNull().alias("stamped"))


_READ = f"""select strftime({_STAMP}, '%Y-%m-%dT%H:%M:%S') as "timestamp", case when conv_id % 3 = 0 then 'unknown' else conv_id::varchar end as chat_id, role as sender,
role = 'assistant' as is_me, trim(text) as text from conversations where turn % 7 <> 6 and trim(text) <> ''"""


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    """Every third conversation has lost its name."""
    return _messages(spark, sf).select(
        F.col("timestamp").alias("Date"), F.col("sender").alias("Sender"), F.col("text").alias("Message"),
        F.when(F.col("chat_id").cast("long") % 3 != 0, F.col("chat_id")).otherwise("").alias("Chat"))


def _seconds(rows: DataFrame) -> DataFrame:
    """Without the zone, which is the session's."""
    return rows.withColumn("timestamp", F.substring("timestamp", 1, 19))


@query(_READ)
def csv_messages(spark, sf):
    path = scratch(spark, "csv")
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _exported(spark, sf).write.options(**options).csv(path)
    return _seconds(messages.read_csv(spark, path, "assistant"))


@query(_READ)
def json_messages(spark, sf):
    path = scratch(spark, "json")
    sinks.write_json_array(_exported(spark, sf), path)
    return _seconds(messages.read_json(spark, path, "assistant", messages.CSV_COLUMNS))


@query("""with r as (select text, role, turn, row_number() over (order by conv_id, turn) - 1 as k from conversations)
select 'pair_' || k as doc_id, k::bigint as index, text || chr(10) || role as text from r where turn % 5 <> 4""")
def pairs_corpus(spark, sf):
    """A JSON list of pairs in which every fifth turn's response is empty."""
    path = scratch(spark, "corpus")
    rows = table(spark, sf, "conversations").orderBy("conv_id", "turn").select(F.col("text").alias("instruction"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("role")).alias("response"))
    sinks.write_json_array(rows, path)
    return messages.read_corpus(spark, path).select("doc_id", F.col("metadata.index").alias("index"), "text")


@query("""select conv_id::varchar as id, case when turn % 2 = 0 then text else role end as instruction, role as response from conversations
where turn % 5 <> 4 and coalesce(case when turn % 2 = 0 then text else role end, '') <> ''""")
def normalised_pairs(spark, sf):
    """Pairs under either of their names: the cleaned field counts where the plain one is empty."""
    rows = table(spark, sf, "conversations").select(
        F.when(F.col("turn") % 2 == 0, F.col("text")).alias("instruction"), F.col("role").alias("instruction_clean"),
        F.when(F.col("turn") % 5 != 4, F.col("role")).otherwise("").alias("response"), F.col("conv_id").cast("string").alias("id"))
    kept = medallion.normalised_pairs(rows.withColumn("response", F.when(F.col("response") != "", F.concat_ws("\x01", "response", "id")).otherwise("")))
    return kept.select(F.split("response", "\x01")[1].alias("id"), "instruction", F.split("response", "\x01")[0].alias("response"))


@query("""select event_id::varchar as "timestamp", (event_id % 3 - 1)::int as rating, case when event_id % 5 = 0 then 'fixed' else '' end as correction
from events where event_id % 10 <> 7""")
def feedback_log(spark, sf):
    """A log in which every tenth line is broken."""
    path = scratch(spark, "feedback")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("timestamp"), F.col("event_type").alias("message"), (F.col("event_id") % 3 - 1).alias("rating"),
                              F.when(F.col("event_id") % 5 == 0, "fixed").otherwise("").alias("correction")))
    table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 7, '{"timestamp": ').otherwise(line).alias("value")).write.text(path)
    return messages.read_feedback(spark, path, strict=False).select("timestamp", "rating", "correction")


@query("select trim(p_name) as term, count(*)::bigint as n from part where trim(p_name) <> '' group by 1")
def term_list(spark, sf):
    path = scratch(spark, "terms")
    lines = F.array(F.concat(F.lit("# "), "p_type"), F.lit(""), F.concat(F.lit("  "), "p_name", F.lit(" ")))
    table(spark, sf, "part").select(F.explode(lines).alias("value")).write.text(path)
    return messages.read_terms(spark, path).groupBy("term").agg(F.count("*").alias("n"))


@query("select n_name as text from nation union all select r_name from region, nation where r_regionkey = n_regionkey and n_nationkey % 2 = 0 union all select '' from nation where n_nationkey % 2 = 1")
def field_texts(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, (n.n_regionkey == r.r_regionkey) & (n.n_nationkey % 2 == 0), "left")
    return messages.read_fields(rows, ["n_name", "r_name"])


@query("""select strftime(timestamp '2026-01-01 10:00:00' + to_seconds(n_nationkey), '%Y-%m-%dT%H:%M:%S') as "timestamp", n_regionkey::varchar as chat_id,
coalesce(r_name, case when n_nationkey % 4 = 0 then 'me' else 'unknown' end) as sender, n_nationkey % 4 = 0 as is_me, n_name as text
from nation left join region on r_regionkey = n_regionkey and r_regionkey < 3 where n_nationkey % 5 <> 4""")
def sqlite_messages(spark, sf):
    """The 25 nations as messages of a SQLite file whose contacts are three regions; blank bodies and both units of time occur."""
    path = _local(spark, "sqlite")
    nations = [(n.n_nationkey, n.n_name, n.n_regionkey) for n in table(spark, sf, "nation").collect()]
    regions = [(r.r_regionkey, r.r_name) for r in table(spark, sf, "region").filter("r_regionkey < 3").collect()]
    base = 1767261600
    rows = [((base + k) * (1000 if k % 2 else 1), " " if k % 5 == 4 else name, str(region), int(k % 4 == 0), region) for k, name, region in nations]
    with sqlite3.connect(path) as db:
        db.execute("create table messages(timestamp, body, chat_id, is_outgoing, sender_id)")
        db.execute("create table contacts(id, name)")
        db.executemany("insert into messages values (?,?,?,?,?)", rows)
        db.executemany("insert into contacts values (?,?)", regions)
    files.register(spark)
    return _seconds(spark.read.format("sqlite_messages").load(path))


@query("select n_name as instruction, 're ' || r_name as response, n_nationkey::varchar as \"timestamp\", 'email' as source from nation join region on r_regionkey = n_regionkey")
def mbox_replies(spark, sf):
    """A mail for each of the 25 nations and an answer that names its region."""
    path = _local(spark, "mbox")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    box = mailbox.mbox(path)
    for x in n.join(r, n.n_regionkey == r.r_regionkey).collect():
        box.add(f"From: a@b\nMessage-ID: <q{x.n_nationkey}>\n\n{x.n_name}")
        box.add(f"From: Me <me@z>\nMessage-ID: <a{x.n_nationkey}>\nIn-Reply-To: <q{x.n_nationkey}>\nDate: {x.n_nationkey}\n\nre {x.r_name}")
    box.close()
    files.register(spark)
    found = medallion.reply_pairs(spark.read.format("mbox").load(path), ["me@z"])
    return found.select(F.rtrim(F.regexp_replace("instruction", r"\s+\z", "")).alias("instruction"), F.regexp_replace("response", r"\s+\z", "").alias("response"), "timestamp", "source")


@query("""select case when n_name is null then r_name || ':' else '  - ' || n_name end as line, count(*)::bigint as n
from (select r_name, n_name from nation join region on r_regionkey = n_regionkey union all select r_name, null from region) where r_name <> 'ASIA' group by 1""")
def configuration_lines(spark, sf):
    """A YAML file of regions and their nations, read, without one key, as lines."""
    path = _local(spark, "yaml")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = r.join(n, n.n_regionkey == r.r_regionkey, "left").groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names")).collect()
    with open(path, "w", encoding="utf-8") as f:
        f.write("world:\n  regions:\n" + "".join(f"    {x.r_name}: [{', '.join(x.names)}]\n" for x in rows))
    tree = messages.without_keys(messages.lookup(messages.read_config(path), "world.regions"), {"ASIA"})
    lines = spark.createDataFrame([(line,) for line in messages.flatten(tree)], "line string")
    return lines.groupBy(F.regexp_replace("line", "NATION ", "NATION_").alias("line")).agg(F.count("*").alias("n"))


@query("select lower(n_name) as term, (select count(distinct n_name) from nation) || ' confirmed surname stems loaded' as status from nation")
def gazetteer_terms(spark, sf):
    """The nations as a gazetteer file, the second of the paths that are tried."""
    path = _local(spark, "names")
    with open(path, "w", encoding="utf-8") as f:
        f.write("# names\n\n" + "".join(f"{x.n_name}\n" for x in table(spark, sf, "nation").collect()))
    terms = messages.read_gazetteer([path + "-none", path])
    return spark.createDataFrame([(t, messages.gazetteer_status(terms)) for t in terms], "term string, status string")


# Sinks ----------------------------------------------------------------------------------------


@query("select doc_id, text, (select count(*) from documents)::bigint as written from documents")
def json_export(spark, sf):
    path = scratch(spark, "export")
    n = sinks.export(table(spark, sf, "documents").select("doc_id", "text"), f"{sf}/documents.parquet", path)
    return spark.read.schema("doc_id long, text string").json(path).withColumn("written", F.lit(n).cast("long"))


@query("select count(*)::bigint as first_lines, 2 * count(*)::bigint as lines from events")
def log_lines(spark, sf):
    path = scratch(spark, "log")
    rows = table(spark, sf, "events").select("event_id", "event_type")
    first = sinks.log(rows, path)
    return spark.createDataFrame([(first, sinks.log(rows, path))], "first_lines long, lines long")


@query("""select (run * (select count(*) from region) + row_number() over (partition by run order by r_regionkey) - 1)::bigint as entry, r_name as name
from region, (values (0), (1)) v(run)""")
def history_entries(spark, sf):
    path = scratch(spark, "history")
    rows = table(spark, sf, "region").orderBy("r_regionkey").select(F.col("r_name").alias("name"))
    sinks.append_history(rows, path)
    return sinks.append_history(rows, path).select("entry", "name")


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # noqa: BLE001 - the session may have ended; nothing depends on it
        pass


@query("""select event_type, 2 * count(*)::bigint as n, 2 * count(distinct user_id)::bigint as n_users_twice from events group by event_type""")
def managed_tables(spark, sf):
    """A table replaced, appended to, and queried into another one."""
    name = f"colloq_round_trip.t{uuid.uuid4().hex}"
    sinks.ensure_schema(spark, "colloq_round_trip")
    for t in (name, f"{name}_q"):
        atexit.register(_drop, spark, t)
    rows = table(spark, sf, "events").select("event_type", "user_id")
    for write in (sinks.replace, sinks.replace, sinks.append):
        write(rows, name)
    sinks.create_as(spark, f"{name}_q", f"with e as (select event_type, count(*) as n, 2 * count(distinct user_id) as n_users_twice from {name} group by event_type) select * from e")
    return spark.table(f"{name}_q")


# Streams --------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a stream; a pattern, since a stream's plain path must be a folder."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/{{events.parquet}}")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _whole(stream: DataFrame, tag: str) -> DataFrame:
    """The result of a stream over all that is there (complete mode): each batch replaces the one before."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, tag)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, f"{tag}-checkpoint"))
    writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("select conv_id::varchar as chat_id, count(*)::bigint as n, true as stamped from conversations group by conv_id")
def stream_ingest(spark, sf):
    """Files ingested once, though the stream runs twice."""
    source, path, checkpoint = (scratch(spark, f"ingest-{x}") for x in ("in", "out", "checkpoint"))
    sinks.write_jsonl(_messages(spark, sf), source)
    for _ in range(2):
        streams.ingest(streams.message_stream(spark, source), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).groupBy("chat_id").agg(F.count("*").alias("n"), F.bool_and(F.col("_ingested_at").isNotNull()).alias("stamped"))


@query("""with g as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
t as (select *, sum(case when prev is null or ts - prev >= interval 4 hours then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, min(ts) as start_ts, max(ts) + interval 4 hours as end_ts, count(*)::bigint as n from t group by user_id, k""")
def stream_sessions(spark, sf):
    s = _whole(streams.session_stream(_events(spark, sf), "user_id", "ts"), "sessions")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")


@query("select time_bucket(interval 6 hours, ts) as start_ts, event_type, count(*)::bigint as n from events group by all")
def stream_windows(spark, sf):
    w = _whole(streams.window_counts(_events(spark, sf), "ts", "6 hours", keys=("event_type",)), "windows")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n")


@query("select distinct 'system:' || substr(sha256(event_type || ' ' || user_id), 1, 16) as identity from events")
def stream_fresh_signals(spark, sf):
    """Each identity passes once; the watermark covers the table's month."""
    path, checkpoint = scratch(spark, "fresh"), scratch(spark, "fresh-checkpoint")
    summary = F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"))
    signals = _events(spark, sf).select("ts", F.lit("system").alias("source"), F.lit("").alias("key"), summary.alias("summary"))
    fresh = streams.fresh_signals(signals, "ts", "60 days")
    fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    return spark.read.parquet(path).select("identity")


@query("select count(*) filter (event_id % 5 = 0 or event_id % 3 - 1 < 0)::bigint as pending, count(*)::bigint as n from events")
def stream_pending(spark, sf):
    path = scratch(spark, "pending")
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("timestamp"), (F.col("event_id") % 3 - 1).cast("int").alias("rating"), F.when(F.col("event_id") % 5 == 0, "fixed").alias("correction"))
    sinks.write_jsonl(rows, path)
    waiting = _whole(streams.pending_count(spark, path), "pending-out")
    return waiting.select(long(F.col("pending")).alias("pending"), "n")


@query("""with g as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
t as (select *, sum(case when prev is null or ts - prev >= interval 4 hours then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g),
s as (select user_id, min(ts) as start_ts, max(ts) + interval 4 hours as end_ts, count(*)::bigint as n from t group by user_id, k)
select * from s where end_ts <= (select max(ts) from events) - interval 1 day""")
def stream_closed_sessions(spark, sf):
    """Sessions written once they are closed, over four lots in the order of time; those of the last day stay open."""
    source, path, checkpoint = (scratch(spark, f"closed-{x}") for x in ("in", "out", "checkpoint"))
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    lot = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for k in range(4):  # a lot is as many files as its tasks write, and one batch: the stream goes on where it stopped
        rows.filter(lot == k).write.mode("append").parquet(source)
        closed = stateful.closed_sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(source), "user_id", "ts")
        stateful.run(closed, path, checkpoint)
    s = spark.read.parquet(path)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")
