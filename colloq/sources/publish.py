"""Publication that is checked first: files are written aside, read back, judged, and only then moved to their place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def _path(spark: SparkSession, path: str):
    """(file system, qualified path), so that ``/x``, ``file:/x`` and ``file:///x/`` are one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def same_place(spark: SparkSession, a: str, b: str) -> bool:
    """Whether one of two paths is, or holds, the other."""
    one, other = (str(_path(spark, x)[1]).rstrip("/") + "/" for x in (a, b))
    return one.startswith(other) or other.startswith(one)


def refuse_source(df: DataFrame, path: str) -> None:
    """ValueError if ``df`` reads files at ``path``, under it, or above it."""
    for source in df.inputFiles():
        if same_place(df.sparkSession, source, path):
            raise ValueError(f"{path} would overwrite its source {source}")


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, form: str = "parquet", replace: bool = False, **options: str) -> None:
    """Write ``df`` to ``path`` if ``check`` accepts the files written.

    ``check`` gets the table as read back from the files, not the plan that made them, and raises to refuse. The
    files are renamed to their place after that; a failure leaves nothing behind, and an older table at ``path`` as it was.
    With ``replace`` the older table is moved aside before and deleted after. (Object stores copy on rename.)
    """
    spark = df.sparkSession
    refuse_source(df, path)
    fs, target = _path(spark, path)
    if fs.exists(target) and not replace:
        raise FileExistsError(path)
    mark = uuid.uuid4().hex
    staged, old = (_path(spark, f"{str(target).rstrip('/')}.{kind}-{mark}")[1] for kind in ("staged", "old"))
    try:
        df.write.format(form).options(**options).save(str(staged))
        if check is not None:
            check(spark.read.schema(df.schema).format(form).options(**options).load(str(staged)))
        if fs.exists(target) and not fs.rename(target, old):
            raise OSError(f"{path} could not be moved aside")
        if not fs.rename(staged, target):
            if fs.exists(old):
                fs.rename(old, target)
            raise OSError(f"{staged} could not be moved to {path}")
        fs.delete(old, True)
    finally:
        fs.delete(staged, True)


def write_json_array(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, files: int = 1) -> None:
    """A JSON list, an element a line: one file, or up to ``files`` files whose contents one after the other are the list.

    The order is that of ``df``. Rows are written aside first; so the first row is known and tasks can
    write files of their own: a comma goes before each row but the first, the brackets are rows of their own.
    """
    spark = df.sparkSession
    refuse_source(df, path)
    aside = f"{str(_path(spark, path)[1]).rstrip('/')}.rows-{uuid.uuid4().hex}"
    fs, at = _path(spark, aside)
    try:
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).withColumn("i", F.monotonically_increasing_id()).write.parquet(aside)
        rows = spark.read.parquet(aside)
        first = rows.agg(F.min("i")).first()[0]
        body = rows.withColumn("value", F.concat(F.when(F.col("i") == first, "").otherwise(","), "value"))
        mark = lambda c, i: spark.range(1).select(F.lit(c).alias("value"), F.lit(i).cast("long").alias("i"))
        lines = mark("[", -1).unionAll(body).unionAll(mark("]", (1 << 63) - 1))
        ordered = (lines.coalesce(1) if files == 1 else lines.repartitionByRange(files, "i")).sortWithinPartitions("i").select("value")

        def whole(lines: DataFrame) -> None:
            if lines.filter("value = '['").count() != 1 or lines.count() != rows.count() + 2:
                raise ValueError("the files are not the rows")
            if check is not None:
                check(lines)

        publish(ordered, path, whole, "text")
    finally:
        fs.delete(at, True)


def replace_days(df: DataFrame, path: str, day: str, days: Sequence) -> None:
    """Write the rows of ``days`` into a table partitioned by ``day``: those days are replaced, all others stay.

    Files of other days are not touched; a day of the list without a row is removed.
    """
    spark = df.sparkSession
    rows = written(df, "days")
    # A day's rows meet, so it gets few files and not one from every task; adaptive execution cuts large days.
    rows.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    there = {str(r[0]) for r in rows.select(day).distinct().collect()}  # at most the days asked
    for d in {str(d) for d in days} - there:
        fs, at = _path(spark, f"{path.rstrip('/')}/{day}={d}")
        fs.delete(at, True)
