"""Nested JSON as rows: every node of every row's tree, level by level, without a walk on the driver."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Levels of a tree, at most; deeper ones are an error.
MOST_LEVELS = 100


def _kind(v: Column) -> Column:
    schema = F.schema_of_variant(v)
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "VOID", "null").otherwise("leaf")


def nodes(rows: DataFrame, keys: list[str], json: str, drop: Collection[str] = (), most: int = MOST_LEVELS) -> DataFrame:
    """keys, path, depth, key, pos, kind, value of each node: the root (path ``$``, depth 0) and all below it.

    ``kind`` is object, array, leaf or null; ``value`` the text of a leaf. Members named in ``drop`` are left out with
    all that is below them, at any depth. A level is one job over the nodes of the level before; trees are as
    deep as they are few, so the number of jobs is that of the deepest tree's levels. Null and broken JSON have no
    nodes. ``pos`` counts the items of an array, and an object's members in the order of their names.
    """
    spark = rows.sparkSession
    root = rows.select(*keys, F.try_parse_json(json).alias("v")).filter("v is not null")
    level = root.select(*keys, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("pos"), "v")
    out = None
    for _ in range(most):
        level = written(level.withColumn("kind", _kind(F.col("v"))), "level")
        done = level.select(*keys, "path", "depth", "key", "pos", "kind", F.when(F.col("kind") == "leaf", F.try_variant_get("v", "$", "string")).alias("value"))
        out = done if out is None else out.unionByName(done)
        open_ = level.filter("kind in ('object', 'array')")
        if open_.isEmpty():
            return out
        below = open_.select(*keys, "path", "depth", "kind", "v").withColumnRenamed("path", "above").withColumnRenamed("kind", "of").withColumnRenamed("v", "tree")
        below = below.lateralJoin(spark.tvf.variant_explode(F.col("tree").outer()))
        if drop:
            below = below.filter(F.col("key").isNull() | ~F.col("key").isin(*drop))
        step = F.when(F.col("of") == "object", F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = below.select(*keys, F.concat("above", step).alias("path"), (F.col("depth") + 1).alias("depth"), "key", "pos", F.col("value").alias("v"))
    raise ValueError(f"a tree has more than {most} levels")


def leaves(found: DataFrame) -> DataFrame:
    """The nodes without any below: values, nulls, and nothing else (empty lists and objects have no leaf)."""
    return found.filter("kind in ('leaf', 'null')")


def lookup(json: str, path: str, default: str | None = None) -> Column:
    """A value's text by dotted path (``a.b.c``); the default where the path ends before, or the JSON is broken."""
    at = "$" + "".join(f"['{p}']" for p in path.split("."))
    found = F.try_variant_get(F.try_parse_json(F.col(json)), at, "string")
    return found if default is None else F.coalesce(found, F.lit(default))


def lines(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line: each node as an indented line ``label: value``, in the order of the paths; underscores of labels become spaces.

    A tree is one document, so its lines meet by nature.
    """
    pad = F.repeat(F.lit("  "), F.col("depth") - 1)
    label = F.replace("key", F.lit("_"), F.lit(" "))
    text = F.coalesce("value", F.lit("None"))
    line = F.when(F.col("key").isNull(), F.concat(pad, F.lit("- "), text)).when(F.col("kind").isin("object", "array"), F.concat(pad, label, F.lit(":"))).otherwise(
        F.concat(pad, label, F.lit(": "), text))
    # Item numbers are padded, so that the tenth item does not come before the second.
    order = F.regexp_replace(F.regexp_replace("path", r"\[(\d+)\]", "[000000000$1]"), r"\[0*(\d{10})\]", "[$1]")
    shown = found.filter("depth > 0 and not (key is null and kind in ('object', 'array'))")
    return shown.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
