"""Signals: identity, salience, suppression of repeats, and the briefing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.times import greek_date, time_decay

#: Weights of urgencies 1 to 4, and the least total worth speaking.
URGENCY = {1: 0.5, 2: 1.0, 3: 3.0, 4: 4.0}
THRESHOLD = 3.0
#: Names of sources in messages.
SOURCES = {
    "calendar": "το ημερολόγιο", "email": "τα email", "github": "το GitHub",
    "weather": "ο καιρός", "conversation": "οι συνομιλίες", "system": "το σύστημα",
}


def identity(source: Column, key: Column, summary: Column) -> Column:
    """source:key, or source and a digest of the folded, collapsed summary."""
    plain = F.trim(F.regexp_replace(fold(summary), r"\s+", " "))
    return F.concat(source, F.lit(":"), F.coalesce(F.nullif(key, F.lit("")), F.substring(F.sha2(plain, 256), 1, 16)))


def weight(urgency: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in URGENCY.items() for x in kv)), urgency)


def dedupe(signals: DataFrame, keys: list[str], pos: str, said: DataFrame | None = None) -> DataFrame:
    """First of each identity, in order; identities in ``said`` (keys, identity) are left out.

    signals: keys..., pos, source, key, summary, urgency, occurs_at, detail.
    """
    marked = signals.withColumn("identity", identity(F.col("source"), F.col("key"), F.col("summary")))
    if said is not None:
        marked = marked.join(said, [*keys, "identity"], "left_anti")
    w = Window.partitionBy(*keys, "identity").orderBy(pos)
    return marked.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def weighed(signals: DataFrame, now: Column) -> DataFrame:
    return signals.withColumn("weight", weight(F.col("urgency")) * time_decay(F.col("occurs_at"), now))


def salience(signals: DataFrame, keys: list[str], now: Column) -> DataFrame:
    return weighed(signals, now).groupBy(*keys).agg(F.sum("weight").alias("salience"), F.count("*").alias("n"))


def should_speak(signals: DataFrame, keys: list[str], pos: str, now: Column, said: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    return salience(dedupe(signals, keys, pos, said), keys, now).withColumn("speaks", F.col("salience") >= threshold)


def ranked(signals: DataFrame, keys: list[str], pos: str, now: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), pos)
    return weighed(signals, now).withColumn("rank", F.row_number().over(w))


def briefing(signals: DataFrame, keys: list[str], pos: str, now: Column, missing: DataFrame | None = None, said: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """keys, text, status per group. ``missing``: keys, source of what could not be read.

    A degraded group always speaks. A group's signals are one briefing, so its rows meet by nature.
    """
    lines = weighed(dedupe(signals, keys, pos, said), now)
    mark = F.when(F.col("urgency") == 4, "!").when(F.col("urgency") == 3, "⏱").otherwise("→")
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), F.col("detail"))).otherwise("")
    line = F.concat(mark, F.lit(" "), F.col("summary"), detail)
    said_ = lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col(pos).alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("body"),
        F.sum("weight").alias("salience"))
    if missing is None:
        both = said_.withColumn("gone", F.lit(None).cast("string"))
    else:
        names = F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv))
        label = F.coalesce(F.try_element_at(names, F.col("source")), F.col("source"))
        gone = missing.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(label)), ", ").alias("gone"))
        both = said_.join(gone, keys, "full")
    worth = F.coalesce(F.col("salience"), F.lit(0.0)) >= threshold
    status = F.when(worth & F.col("gone").isNull(), "spoke").when(F.col("gone").isNotNull(), "spoke_degraded").otherwise("silent_below_threshold")
    head = F.concat(F.lit("Καλημέρα. "), greek_date(now), F.lit("."))
    tail = F.when(F.col("gone").isNull(), F.lit(None)).when(
        F.col("body").isNotNull(), F.concat(F.lit("Δεν μπόρεσα να δω "), F.col("gone"), F.lit(" — μπορεί να μου ξεφεύγει κάτι."))
    ).otherwise(F.concat(F.lit("Δεν μπόρεσα να δω "), F.col("gone"), F.lit(", οπότε δεν ξέρω αν έχεις κάτι σήμερα.")))
    text = F.when(status.startswith("silent"), "").otherwise(F.concat_ws("\n\n", head, F.col("body"), tail))
    return both.select(*keys, text.alias("text"), status.alias("status"))
