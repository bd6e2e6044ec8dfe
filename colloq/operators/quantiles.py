"""Exact quantiles of groups of any size by iterative range narrowing.

A large group's values are never held together. Its range is cut into buckets, one aggregation
counts them (with each bucket's least and largest value), and only the bucket that holds the wanted
rank is cut again, until it holds one value or few enough rows to sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .sessions import large_keys

BUCKETS = 1024
#: Rows that may be sorted for one rank, and groups beyond that at most: so many ranges are broadcast, for each rank.
SORT_ROWS, MOST_GROUPS = 100_000, 10_000


def ranks_of(n: Column) -> dict[str, Column]:
    """Ranks from 1 of both middle values, and of the smallest value with 95 % at or below it."""
    return {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.greatest(F.ceil(n * F.lit(0.95)), F.lit(1))}


def ranked_values(rows: DataFrame, value: str, keys: Sequence[str], ranks=ranks_of, sort_rows: int = SORT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """keys, which, found: the values of the ranks (name to rank from the group's count) in ascending order.

    Null values and NaN do not count. For groups of up to ``sort_rows`` rows one sort; larger ones
    are narrowed. Each step strictly shrinks a range: its least and largest value fall into different buckets.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    held = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    held = held.withColumn("g", F.struct(F.lit(0).alias("_0"), *named)).select("g", "v")
    large, n, sort_rows = large_keys(held, "g", sort_rows, MOST_GROUPS)
    hot = F.broadcast(large.select(F.col("g").alias("h")))
    small = held.join(hot, F.col("g").eqNullSafe(F.col("h")), "left_anti") if n else held
    per = small.groupBy("g", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v"))
    total = F.sum("c").over(Window.partitionBy("g"))
    per = per.withColumn("upto", upto).withColumn("total", total)
    wanted = F.array(*(F.struct(F.lit(w).alias("which"), r.cast("long").alias("r")) for w, r in ranks(F.col("total")).items()))
    here = F.filter(wanted, lambda x: (x["r"] <= F.col("upto")) & (x["r"] > F.col("upto") - F.col("c")))
    done = [per.select("g", "v", F.explode(here).alias("x")).select("g", "x.which", F.col("v").alias("found"))]
    if n:
        done += _narrowed(written(held.join(hot, F.col("g").eqNullSafe(F.col("h"))).drop("h"), "large"), large, ranks, sort_rows, buckets)
    all_ = reduce(DataFrame.unionByName, done)
    return all_.select(*(F.col(f"g.{n}").alias(k) for k, n in zip(keys, named, strict=True)), "which", "found")


def _narrowed(held: DataFrame, large: DataFrame, ranks, sort_rows: int, buckets: int) -> list[DataFrame]:
    """The values of the ranks of large groups."""
    which = F.explode(F.map_from_arrays(F.array(*map(F.lit, ranks(F.col("n")))), F.array(*(r.cast("long") for r in ranks(F.col("n")).values()))))
    ends = held.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    state = large.select("g", "n", which.alias("which", "r")).join(ends.withColumnRenamed("g", "e"), F.col("g").eqNullSafe(F.col("e"))).drop("e")
    state = written(state, "ranges")  # a row for each large group and rank: g, n, which, r, low, high
    done = []
    while True:
        done.append(state.filter("low = high").select("g", "which", F.col("low").alias("found")))
        few = state.filter(f"low < high and n <= {sort_rows}")
        if not few.isEmpty():
            inside = _inside(held, few).groupBy("g", "which", "r", "v").agg(F.count("*").alias("c"))
            inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "which").orderBy("v")))
            done.append(inside.filter("r <= upto and r > upto - c").select("g", "which", F.col("v").alias("found")))
        state = state.filter(f"low < high and n > {sort_rows}")
        if state.isEmpty():
            return done
        # Halves first, so that the difference of two finite doubles stays finite; no share where an end is infinite.
        share = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        share = F.when(share.isNull() | F.isnan(share), 1).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 2)))
        bucket = F.when(F.col("v") == F.col("high"), buckets - 1).when(F.col("v") == F.col("low"), 0).otherwise(share)
        counted = _inside(held, state).withColumn("b", bucket.cast("int")).groupBy("g", "which", "r", "b").agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "which").orderBy("b")))
        hit = counted.filter("r <= upto and r > upto - n")
        state = written(hit.select("g", "n", "which", (F.col("r") - (F.col("upto") - F.col("n"))).alias("r"), "low", "high"), "ranges")


def _inside(held: DataFrame, state: DataFrame) -> DataFrame:
    """The values of each range, with the range. At most ``MOST_GROUPS`` ranges for each rank, so they are broadcast."""
    ranges = F.broadcast(state.select(F.col("g").alias("s"), "which", "r", "low", "high"))
    return held.join(ranges, F.col("g").eqNullSafe(F.col("s")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).drop("s")


def latency(rows: DataFrame, value: str, keys: Sequence[str] = (), sort_rows: int = SORT_ROWS) -> DataFrame:
    """``metrics.latency`` for groups of any size: mean, interpolated median, p95 and n.

    A group without a value has nulls and n = 0, as there; NaN does not count here.
    """
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    means = rows.groupBy(*keys).agg(F.avg(number).alias("mean_s"), F.count(number).alias("n"))
    found = ranked_values(rows, value, keys, sort_rows=sort_rows).groupBy(*keys).agg(
        *(F.max(F.when(F.col("which") == w, F.col("found"))).alias(f"_{w}") for w in ("low", "high", "p95")))
    found = found.select(F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") / 2 + F.col("_high") / 2).alias("median_s"), F.col("_p95").alias("p95_s"), *(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    return means.join(found, same, "left").select(*keys, "mean_s", "median_s", "p95_s", "n")
