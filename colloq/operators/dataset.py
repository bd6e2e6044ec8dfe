"""Training sets: templates, split, shards, oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chat_format(model: Column) -> Column:
    lowered = F.lower(model)
    return F.when(F.contains(lowered, F.lit("mistral")) | F.contains(lowered, F.lit("mixtral")), "mistral").otherwise("llama3")


def template(instruction: Column, response: Column, kind: str = "llama3") -> Column:
    """One training text in the named chat format."""
    if kind == "mistral":
        return F.concat(F.lit("<s>[INST] "), instruction, F.lit(" [/INST] "), response, F.lit("</s>"))
    if kind == "llama3":
        return F.concat(
            F.lit("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"), instruction,
            F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"), response, F.lit("<|eot_id|>"))
    raise ValueError(f"unknown chat format {kind}")


def messages(instruction: Column, response: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", instruction), turn("assistant", response))


def split(rows: DataFrame, id_: str, ratio: float = 0.1, salt: int = 0) -> DataFrame:
    """Adds ``part``: exactly max(1, int(n * ratio)) rows are val, the others train.

    The order is an integer hash of the id that any engine can compute; the cut is found from
    the counts per hash bucket, so no task sorts all rows.
    """
    h = F.pmod((F.col(id_).cast("decimal(38,0)") + salt) * F.lit(2654435761).cast("decimal(38,0)"), F.lit(4294967296).cast("decimal(38,0)")).cast("long")
    marked = rows.withColumn("_h", h)
    n = marked.count()
    if not n:
        return rows.withColumn("part", F.lit("train"))
    n_val = max(1, int(n * ratio))
    width = max(1, (1 << 32) // max(1, min(n, 100_000)))
    buckets = marked.groupBy(F.floor(F.col("_h") / width).alias("b")).agg(F.count("*").alias("c")).orderBy("b").collect()
    before, cut = 0, 0
    for b in buckets:
        cut = b.b
        if before + b.c >= n_val:
            break
        before += b.c
    edge = marked.filter(F.floor(F.col("_h") / width) == cut)
    chosen = edge.orderBy("_h", id_).limit(n_val - before).select(id_).withColumn("_in", F.lit(True))
    joined = marked.join(chosen, id_, "left")
    part = F.when((F.floor(F.col("_h") / width) < cut) | F.coalesce("_in", F.lit(False)), "val").otherwise("train")
    return joined.select(*rows.columns, part.alias("part"))


def shard(rows: DataFrame, order: str, workers: int) -> DataFrame:
    """Adds ``worker``: element i goes to worker i modulo ``workers``.

    Positions come from counts per range partition, so no task sees all rows.
    """
    if workers < 1:
        raise ValueError("workers must be positive")
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    first = parts.groupBy("_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_p", "_first", "_before")
    return parts.join(F.broadcast(starts), "_p").select(*rows.columns, F.pmod(F.col("_before") + F.col("_i") - F.col("_first"), F.lit(workers)).cast("int").alias("worker"))


def oversample(rows: DataFrame, golden: DataFrame, times: int = 3) -> DataFrame:
    repeated = golden.withColumn("_", F.explode(F.array_repeat(F.lit(1), times))).drop("_")
    return rows.unionByName(repeated)


def effective_batch(per_device: int, accumulation: int, workers: int) -> int:
    return per_device * accumulation * workers
