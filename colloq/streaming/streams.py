"""Structured Streaming twins of ingest, sessions, suppression of repeats and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.agency import identity
from ..sources.messages import FEEDBACK, MESSAGE


def message_stream(spark: SparkSession, path: str, schema: str = MESSAGE) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new since the last run, then stop; exactly once through the checkpoint."""
    rows = stream.withColumn("_ingested_at", F.current_timestamp())
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def session_stream(stream: DataFrame, chat: str, ts: str, minutes: int = 240, late: str = "1 day") -> DataFrame:
    """Sessions closed by a silence; later events than ``late`` are left out."""
    rows = stream.withWatermark(ts, late)
    window = F.session_window(F.col(ts), f"{minutes} minutes")
    return rows.groupBy(F.col(chat), window.alias("w")).agg(F.count("*").alias("n")).select(chat, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(stream: DataFrame, ts: str, width: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per tumbling (or sliding) window."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    rows = stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def fresh_signals(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Signals whose identity was not seen within the watermark."""
    marked = stream.withColumn("identity", identity(F.col("source"), F.col("key"), F.col("summary")))
    return marked.withWatermark(ts, late).dropDuplicatesWithinWatermark(["identity"])


def pending_count(spark: SparkSession, path: str) -> DataFrame:
    """Running number of feedback lines that wait for a review (complete mode)."""
    log = spark.readStream.schema(FEEDBACK).json(path)
    waiting = (F.coalesce("correction", F.lit("")) != "") | (F.col("rating") < 0)
    return log.groupBy().agg(F.count_if(waiting).alias("pending"), F.count("*").alias("n"))
