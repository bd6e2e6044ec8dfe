"""Bronze, silver and gold: raw messages to instruction-response pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GREEK, script_tag
from ..functions.times import parse_time, seconds_between

#: A thread ends after a silence longer than this; a reply comes within it.
GAP_MINUTES = 240
MIN_CHARS = 2


def bronze(messages: DataFrame) -> DataFrame:
    """Raw messages with their ingest time."""
    return messages.withColumn("_ingested_at", F.current_timestamp())


def clean(messages: DataFrame, ranges: str = "Ͱ-Ͽ", yes: str = "el", no: str = "en") -> DataFrame:
    """Parsed time, language tag, no blank texts; one row of equal (ts, sender, text), the smallest chat_id.

    Times that do not parse are dropped. Aggregation keeps one row per key map-side, so a hot key
    costs one row per task.
    """
    kept = messages.withColumn("ts", parse_time(F.col("timestamp"))).filter("ts is not null and text is not null and trim(text) <> ''")
    one = kept.groupBy("ts", "sender", "text").agg(F.min(F.struct("chat_id", "is_me")).alias("first"))
    return one.select("ts", "first.chat_id", "sender", "first.is_me", script_tag(F.col("text"), ranges, yes, no).alias("language"), "text")


def threads(rows: DataFrame, chat: str, ts: str, tie: str, minutes: int = GAP_MINUTES) -> DataFrame:
    """Adds thread_id: numbered from 1 within a chat, a new one after a gap longer than ``minutes``.

    ``tie`` orders rows of equal time, so results do not depend on the plan. Lag and running sum
    share one window, hence one shuffle and one sort.
    """
    w = Window.partitionBy(chat).orderBy(ts, tie)
    before = F.lag(ts).over(w)
    new = before.isNull() | (seconds_between(before, F.col(ts)) > minutes * 60)
    return rows.withColumn("_new", new.cast("int")).withColumn(
        "thread_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_new")


def sessions(rows: DataFrame, chat: str, ts: str, minutes: int = GAP_MINUTES) -> DataFrame:
    """The same sessions by ``session_window``: one row each with start, end (``minutes`` after its last row) and size.

    As in ``threads``, a gap is counted in whole seconds: windows are those of floored times, half a second
    longer than the gap, so that neither a fraction nor a limit met exactly decides. Rows without a time are left out.
    """
    whole = F.col(ts) - F.make_dt_interval(secs=F.date_part(F.lit("second"), ts) % 1)
    window = F.session_window(whole, f"{minutes * 60_000 + 500} milliseconds")
    found = rows.groupBy(F.col(chat), window.alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return found.select(chat, "start", (F.col("last") + F.make_dt_interval(mins=F.lit(minutes))).alias("end"), "n")


def pairs(rows: DataFrame, keys: list[str], order: list[str], is_me: Column, text: str, ts: str | None = None, minutes: int = GAP_MINUTES) -> DataFrame:
    """Neighbours (theirs, then mine) of a thread: adds response and, with ``ts``, response_ts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_me", is_me).withColumn("response", F.lead(text).over(w)).withColumn("_next", F.lead("_me").over(w))
    good = ~F.col("_me") & F.col("_next") & (F.length(text) >= MIN_CHARS) & (F.length("response") >= MIN_CHARS)
    if ts:
        marked = marked.withColumn("response_ts", F.lead(ts).over(w))
        good = good & (seconds_between(F.col(ts), F.col("response_ts")) <= minutes * 60)
    return marked.filter(good).drop("_me", "_next")


def gold_pairs(silver: DataFrame) -> DataFrame:
    """instruction, response, instruction_ts, chat_id, thread_id, language."""
    found = pairs(silver, ["chat_id", "thread_id"], ["ts", "sender", "text"], F.col("is_me"), "text", "ts")
    return found.select(F.col("text").alias("instruction"), "response", F.col("ts").alias("instruction_ts"), "chat_id", "thread_id", "language")


def silver(messages: DataFrame) -> DataFrame:
    return threads(clean(messages).withColumn("_tie", F.struct("sender", "text")), "chat_id", "ts", "_tie").select(
        "ts", "chat_id", "thread_id", "sender", "is_me", "language", "text")


def gold_chunks(pairs_: DataFrame, embed=None, translate=None, language: str = "el") -> DataFrame:
    """chunk_text, embed_text, embedding; ``translate`` and ``embed`` are column functions.

    Without them texts stay as they are and the embedding is a fixed hash projection.
    """
    chunk = F.concat_ws(" → ", "instruction", "response")
    embed_text = F.when(F.col("language") == language, translate(F.col("chunk_text"))).otherwise(F.col("chunk_text")) if translate else F.col("chunk_text")
    rows = pairs_.withColumn("chunk_text", chunk).withColumn("embed_text", embed_text)
    return rows.withColumn("embedding", (embed or hash_embedding)(F.col("embed_text"))).select(
        "chunk_text", "embed_text", "embedding", "language", "chat_id", "thread_id", "instruction_ts")


def hash_embedding(text: Column, size: int = 16) -> Column:
    """A deterministic stand-in for a model: one hash per component, in [-1, 1)."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (F.pmod(F.xxhash64(text, k), F.lit(2000)) / 1000 - 1).cast("float"))


def non_empty(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def normalised_pairs(rows: DataFrame) -> DataFrame:
    """instruction and response under either of their names; rows that lack one are dropped."""
    have = set(rows.columns)
    pick = lambda name: non_empty(*[c for c in (name, f"{name}_clean") if c in have] or ["__none"])
    for c in ("instruction", "response"):
        if not {c, f"{c}_clean"} & have:
            raise ValueError(f"no column for {c}")
    return rows.select(pick("instruction").alias("instruction"), pick("response").alias("response")).filter(
        "instruction is not null and response is not null")


def feedback_pairs(log: DataFrame) -> DataFrame:
    """Positively rated replies as pairs; a correction replaces the reply."""
    return log.filter("rating = 1").select(F.col("message").alias("instruction"), non_empty("correction", "reply").alias("response"), "timestamp")


def pending_reviews(log: DataFrame) -> DataFrame:
    return log.filter((F.coalesce("correction", F.lit("")) != "") | (F.col("rating") < 0))


def reply_pairs(mails: DataFrame, mine: list[str]) -> DataFrame:
    """Replies of mine joined with the foreign message they answer; of equal ids the last message counts.

    mails: pos, message_id, in_reply_to, sender, date, body.
    """
    lowered = F.lower(F.coalesce("sender", F.lit("")))
    is_mine = F.exists(F.array(*(F.lit(m.lower()) for m in mine)), lambda a: F.contains(lowered, a))
    marked = mails.withColumn("mine", is_mine)
    parents = marked.filter("message_id is not null").groupBy("message_id").agg(F.max(F.struct("pos", "mine", "body")).alias("p"))
    parents = parents.filter("not p.mine").select("message_id", F.col("p.body").alias("instruction"))
    replies = marked.filter("mine and in_reply_to is not null").select("in_reply_to", "date", F.col("body").alias("response"))
    return replies.join(parents, replies.in_reply_to == parents.message_id).filter(
        (F.trim("instruction") != "") & (F.trim("response") != "")
    ).select("instruction", "response", F.col("date").alias("timestamp"), F.lit("email").alias("source"))
