"""The catalogue of queries: each is registered with ``@query(sql)`` under its function's name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def long(c: Column) -> Column:
    return c.cast("long")


def literal(texts: Sequence[str]) -> Column:
    at = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(texts))) + 1
    return F.element_at(F.array(*map(F.lit, texts)), at.cast("int"))


def given(spark: SparkSession, sf: str, texts: Sequence[str]) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", literal(texts).alias("text"))


def expected(**columns) -> str:
    def value(v) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    lists = ", ".join(f"[{', '.join(map(value, v))}][(conv_id + turn) % {len(v)} + 1] as {c}" for c, v in columns.items())
    return f"select conv_id, turn, {lists} from conversations"
