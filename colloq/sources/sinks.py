"""Sinks: managed tables, JSON exports, append-only logs, history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import publish
from .publish import write_json_array  # noqa: F401 - a sink like the others


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"create schema if not exists {name}")


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def replace(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines and return their number, counted while they are written."""
    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def export(df: DataFrame, source: str, path: str) -> int:
    """Like ``write_jsonl``, but never onto its own source, however the paths are written."""
    if publish.same_place(df.sparkSession, source, path):
        raise ValueError("the export would overwrite its source")
    return write_jsonl(df, path, "overwrite")


def create_as(spark: SparkSession, table: str, query: str) -> None:
    """Create or replace a managed table from a query, which may chain common table expressions."""
    replace(spark.sql(query), table)


def log(df: DataFrame, path: str) -> int:
    """Append rows to a JSON log; the number of lines that it holds then."""
    df.write.mode("append").json(path)
    return df.sparkSession.read.text(path).count()


def append_history(df: DataFrame, path: str) -> DataFrame:
    """Append entries to a history with their number in it (``entry``, from 0); the whole history, in order.

    A history grows by a few entries a run; it is read, numbered on, and appended to.
    """
    spark = df.sparkSession
    try:
        before = spark.read.json(path).count()
    except AnalysisException:
        before = 0
    w = Window.orderBy(F.monotonically_increasing_id())
    df.withColumn("entry", (F.row_number().over(w) - 1 + before).cast("long")).write.mode("append").json(path)
    return spark.read.json(path).orderBy("entry")
