"""Threads of a chat by a distributed prefix scan, for chats that no task can hold.

``medallion.threads`` sorts each chat in one task. Here a large chat is cut into runs of time, each
run is numbered on its own, and one row per run says what the next run has to add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import seconds_between
from ..session import written
from .medallion import GAP_MINUTES, threads

#: Rows of a run that are aimed at, and runs at most: so many rows of carries are broadcast.
RUN_ROWS, MOST_RUNS = 1_000_000, 20_000


def large_keys(rows: DataFrame, key: str, run_rows: int = RUN_ROWS, most: int = MOST_RUNS) -> tuple[DataFrame, int, int]:
    """Keys with more than a run's rows (key, n), the rows they have, and a run's rows.

    A run is longer where there would be more than ``most`` of them, so there are at most ``most`` large keys.
    """
    counted = written(rows.groupBy(key).agg(F.count("*").alias("n")), "keys")
    total = counted.agg(F.sum("n")).first()[0] or 0
    run_rows = max(run_rows, -(-total // most))
    large = counted.filter(F.col("n") > run_rows)
    return large, large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], run_rows


def is_break(before: Column, now: Column, minutes: int) -> Column:
    return seconds_between(before, now) > minutes * 60


def threads_scan(rows: DataFrame, chat: str, ts: str, tie: str, minutes: int = GAP_MINUTES, run_rows: int = RUN_ROWS) -> DataFrame:
    """``medallion.threads`` with the same result, of which no task reads more than about ``run_rows`` rows of a chat.

    Large chats are dealt by ranges of (chat, ts, tie) into runs. A run numbers its breaks from 0 and
    emits its first and last time; the runs of a chat are added up over a table of at most two rows for each
    range, which is broadcast back. Times must not be null. Rows that are equal in all three columns
    stay in one run.
    """
    large, n, run_rows = large_keys(rows, chat, run_rows)
    if not n:
        return threads(rows, chat, ts, tie, minutes)
    hot = F.broadcast(large.select(F.col(chat).alias("_hot")))
    few = rows.join(hot, F.col(chat).eqNullSafe(F.col("_hot")), "left_anti")
    many = rows.join(hot, F.col(chat).eqNullSafe(F.col("_hot"))).drop("_hot")
    dealt = many.repartitionByRange(-(-n // run_rows), chat, ts, tie).withColumn("_run", F.spark_partition_id())
    dealt = written(dealt, "runs")
    w = Window.partitionBy(chat, "_run").orderBy(ts, tie)
    breaks = F.coalesce(is_break(F.lag(ts).over(w), F.col(ts), minutes), F.lit(False)).cast("int")
    own = dealt.withColumn("_breaks", breaks)
    # A row per run: what it begins and ends with, and how many breaks it has inside.
    ends = dealt.withColumn("_breaks", breaks).groupBy(chat, "_run").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_breaks").alias("_n"))
    runs = Window.partitionBy(chat).orderBy("_run")
    starts = is_break(F.lag("_last").over(runs), F.col("_first"), minutes)
    carried = ends.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int"))  # the first run starts thread 1
    carried = carried.withColumn("_carry", F.sum(F.col("_start") + F.col("_n")).over(runs) - F.col("_n"))
    carried = F.broadcast(carried.select(F.col(chat).alias("_chat"), F.col("_run").alias("_r"), "_carry"))
    numbered = own.withColumn("_own", F.sum("_breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.join(carried, F.col(chat).eqNullSafe(F.col("_chat")) & (F.col("_run") == F.col("_r")))
    numbered = numbered.withColumn("thread_id", F.col("_own") + F.col("_carry"))
    return threads(few, chat, ts, tie, minutes).unionByName(numbered.select(*rows.columns, "thread_id"))


def pairs_scan(rows: DataFrame, chat: str, ts: str, tie: str, is_me: Column, text: str, minutes: int = GAP_MINUTES, run_rows: int = RUN_ROWS) -> DataFrame:
    """Neighbours (theirs, then mine) within ``minutes`` over whole chats: adds response and response_ts.

    Within a chat a gap of more than ``minutes`` ends a thread, so these are ``medallion.pairs`` of threads. In a
    large chat the first row of the next run is what the last row of a run looks at.
    """
    large, n, run_rows = large_keys(rows, chat, run_rows)
    marked = rows.withColumn("_me", is_me)
    hot = F.broadcast(large.select(F.col(chat).alias("_hot")))
    same = F.col(chat).eqNullSafe(F.col("_hot"))
    value = F.struct(F.col("_me").alias("me"), F.col(text).alias("text"), F.col(ts).alias("ts"))
    few = marked.join(hot, same, "left_anti").withColumn("_next", F.lead(value).over(Window.partitionBy(chat).orderBy(ts, tie)))
    if n:
        many = marked.join(hot, same).drop("_hot").repartitionByRange(-(-n // run_rows), chat, ts, tie).withColumn("_run", F.spark_partition_id())
        many = written(many, "runs")
        first = many.groupBy(chat, "_run").agg(F.min_by(value, F.struct(ts, tie)).alias("_value"))
        first = first.withColumn("_after", F.lead("_value").over(Window.partitionBy(chat).orderBy("_run")))
        first = F.broadcast(first.select(F.col(chat).alias("_chat"), F.col("_run").alias("_r"), "_after"))
        own = many.withColumn("_next", F.lead(value).over(Window.partitionBy(chat, "_run").orderBy(ts, tie)))
        own = own.join(first, F.col(chat).eqNullSafe(F.col("_chat")) & (F.col("_run") == F.col("_r")))
        few = few.unionByName(own.withColumn("_next", F.coalesce("_next", "_after")).select(*few.columns))
    found = few.withColumn("response", F.col("_next.text")).withColumn("response_ts", F.col("_next.ts"))
    good = ~F.col("_me") & F.col("_next.me") & (F.length(text) >= 2) & (F.length("response") >= 2) & ~is_break(F.col(ts), F.col("response_ts"), minutes)
    return found.filter(good).drop("_me", "_next")


def sessions_of(threaded: DataFrame, chat: str, ts: str) -> DataFrame:
    """A row per thread: chat, thread_id, start, last, n; counted map-side, so a hot chat costs a row per task and thread."""
    return threaded.groupBy(chat, "thread_id").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))


def row_numbers(rows: DataFrame, order: list[str], name: str, parts: int = 0) -> DataFrame:
    """Adds ``name``: numbers from 0 over all rows in the order of the columns, without one task that sees all.

    Rows are dealt by ranges, numbered in their range, and moved by how many rows stand in the ranges before: a table
    of a row for each range.
    """
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    counted = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counted.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_own") - 1 + F.col("_before")).drop("_part", "_p", "_own", "_before")
