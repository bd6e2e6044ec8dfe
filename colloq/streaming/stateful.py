"""Streams with state of their own: what was said to a user, and sessions that close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.agency import THRESHOLD, identity, weighed

SPOKEN = "user string, salience double, n long, speaks boolean, body string"
_STATE = "identities array<string>, until array<long>"


def speak_or_wait(stream: DataFrame, user: str, pos: str, ts: str, now: Column, threshold: float = THRESHOLD, remember_hours: int = 24 * 7, late: str = "1 day") -> DataFrame:
    """user, salience, n, speaks, body for every user of a batch, weighing only what was not said before.

    Of equal identities the first by ``pos`` counts. If the fresh signals of a batch weigh ``threshold``,
    they are said: ``body`` has their lines, heaviest first, and their identities are kept for
    ``remember_hours`` after the batch's latest time: a signal of an earlier time is a repeat. What is not said is not kept. State goes when the
    watermark passes its last expiry, so it is bounded by what was said to a user within that time.

    stream: the user, pos, ts, source, key, summary, urgency, occurs_at, detail.
    """
    rows = weighed(stream.withColumn("identity", identity(F.col("source"), F.col("key"), F.col("summary"))), now)
    mark = F.when(F.col("urgency") == 4, "!").when(F.col("urgency") == 3, "⏱").otherwise("→")
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), F.col("detail"))).otherwise("")
    line = F.concat(mark, F.lit(" "), F.col("summary"), detail)
    rows = rows.select(F.col(user).cast("string").alias("user"), F.col(ts).cast("timestamp").alias("at"), F.col(pos).cast("long").alias("pos"), "identity", F.col("weight").cast("double").alias("weight"), line.alias("line"))
    keep = remember_hours * 3_600_000

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        if state.hasTimedOut:
            known = {i: t for i, t in known.items() if t > state.getCurrentWatermarkMs()}
            _keep(state, known)
            return
        fresh: dict[str, tuple] = {}
        latest = 0
        for batch in batches:
            times = [int(t.timestamp() * 1000) for t in batch["at"]]
            latest = max(latest, *times)
            for t, p, i, w, text in zip(times, batch["pos"], batch["identity"], batch["weight"], batch["line"], strict=True):
                if t >= known.get(i, t) and (i not in fresh or p < fresh[i][0]):
                    fresh[i] = (p, w, text)
        watermark = state.getCurrentWatermarkMs()
        known = {i: t for i, t in known.items() if t > watermark}
        salience = sum(w for _, (_, w, _) in sorted(fresh.items(), key=lambda x: x[1][0]))
        speaks = bool(fresh) and salience >= threshold
        if speaks:
            known |= dict.fromkeys(fresh, latest + keep)
        _keep(state, known)
        body = "\n".join(text for _, _, text in sorted(fresh.values(), key=lambda x: (-x[1], x[0]))) if speaks else ""
        yield pd.DataFrame({"user": [key[0]], "salience": [float(salience)], "n": [len(fresh)], "speaks": [speaks], "body": [body]})

    return rows.withWatermark("at", late).groupBy("user").applyInPandasWithState(judge, SPOKEN, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _keep(state: GroupState, known: dict[str, int]) -> None:
    if not known:
        if state.exists:
            state.remove()
        return
    state.update((list(known), list(known.values())))
    state.setTimeoutTimestamp(max(min(known.values()), state.getCurrentWatermarkMs() + 1))


def closed_sessions(stream: DataFrame, chat: str, ts: str, minutes: int = 240, late: str = "1 day") -> DataFrame:
    """Sessions that the watermark has closed, for append mode: each is written once and then leaves the state."""
    window = F.session_window(F.col(ts), f"{minutes} minutes")
    rows = stream.withWatermark(ts, late).groupBy(F.col(chat), window.alias("w")).agg(F.count("*").alias("n"))
    return rows.select(chat, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run(stream: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Run over all that is there, append to ``path``, and stop. Batches, rows of state left, most rows of state, rows too late."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    seen = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    return {
        "batches": len(query.recentProgress), "state": seen[-1].numRowsTotal if seen else 0, "most": max((s.numRowsTotal for s in seen), default=0),
        "late": sum(s.numRowsDroppedByWatermark for s in seen),
    }


def lots(spark: SparkSession, schema: str, path: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files, so many of them in a batch, the older first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
