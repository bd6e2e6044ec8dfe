"""Bronze, clean and pair tables by day, of which new messages rewrite only the days that they touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_time
from ..session import written
from ..sources.publish import replace_days
from .medallion import GAP_MINUTES, clean, pairs


@dataclass
class Days:
    """Tables under ``root``: ``bronze`` (messages as they came), ``clean``, ``pairs``, each partitioned by day."""

    spark: SparkSession
    root: str
    minutes: int = GAP_MINUTES

    def table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing written yet
            return None

    def of(self, name: str, days: list) -> DataFrame:
        """Rows of the days; other days' files are not read."""
        return self.table(name).filter(F.col("day").isin(days))

    def add(self, messages: DataFrame) -> tuple[list, list]:
        """Append messages and bring ``clean`` and ``pairs`` up to date; the days rewritten of each.

        Equal (ts, sender, text) have one day, so a clean day comes from its bronze day alone. A pair
        belongs to the day of its first message and its answer comes within ``minutes``; so a new
        message also touches the day before if it is that close to midnight, and a day's pairs are made of
        its rows and the first ``minutes`` of the next day. Messages whose time does not parse stay in no table.
        """
        ts = parse_time(F.col("timestamp"))
        new = written(messages.withColumn("day", F.to_date(ts)).filter("day is not null"), "new")
        before = F.to_date(ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(self.minutes)))
        touched = new.select("day", before.alias("early")).distinct().collect()  # two days for each day at most
        own = sorted({r.day for r in touched})
        pair_days = sorted({d for r in touched for d in r})
        if not own:
            return [], []
        new.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{self.root}/bronze")
        cleaned = clean(self.of("bronze", own).drop("day")).withColumn("day", F.to_date("ts"))
        replace_days(cleaned, f"{self.root}/clean", "day", own)
        replace_days(self._pairs(pair_days), f"{self.root}/pairs", "day", pair_days)
        return own, pair_days

    def _pairs(self, days: list) -> DataFrame:
        following = [r.d for r in self.spark.range(1).select(F.explode(F.array(*(F.date_add(F.lit(d), 1) for d in days))).alias("d")).collect()]
        rows = self.of("clean", sorted({*days, *following}))
        found = pairs(rows, ["chat_id"], ["ts", "sender", "text"], _mine(), "text", "ts", self.minutes)
        return found.filter(F.col("day").isin(days))


def _mine() -> Column:
    return F.col("is_me")
