"""Lines of context from fetched items, frames around context, and signals from sources.

Connectors are not part of the library: items come as rows that were fetched already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNAL_COLUMNS = ("source", "key", "summary", "urgency", "occurs_at", "detail")


def _or(column: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def _lines(rows: DataFrame, keys: Sequence[str], pos: str, line: Column, head: str, most: int) -> DataFrame:
    """keys, context: the first ``most`` lines of each group under a heading."""
    item = F.struct(F.col(pos).alias("p"), line.alias("l"))
    listed = F.slice(F.sort_array(F.collect_list(item)), 1, most)
    return rows.groupBy(*keys).agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(listed, lambda x: x["l"]), "\n")).alias("context"))


def emails(rows: DataFrame, keys: Sequence[str], pos: str, most: int = 5) -> DataFrame:
    """From date, subject, sender, snippet."""
    line = F.concat(F.lit("- "), _or("date"), F.lit(": "), _or("subject", "Χωρίς θέμα"), F.lit(" (από "), _or("sender", "Άγνωστος"), F.lit(") — "), _or("snippet"))
    return _lines(rows, keys, pos, line, "ΠΡΟΣΦΑΤΑ EMAILS:", most)


def calendar(rows: DataFrame, keys: Sequence[str], pos: str, most: int = 10) -> DataFrame:
    """From start, end, title, location."""
    place = F.when(_or("location") != "", F.concat(F.lit(" ("), F.col("location"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), _or("start"), F.lit(" → "), _or("end"), F.lit(": "), _or("title", "Χωρίς τίτλο"), place)
    return _lines(rows, keys, pos, line, "ΠΡΟΓΡΑΜΜΑ:", most)


def free_slots(rows: DataFrame, keys: Sequence[str], pos: str, most: int = 5) -> DataFrame:
    return _lines(rows, keys, pos, F.concat(F.lit("- "), _or("slot")), "ΔΙΑΘΕΣΙΜΟΤΗΤΑ:", most)


def news(rows: DataFrame, keys: Sequence[str], pos: str, most: int = 5) -> DataFrame:
    """From title, source, description (its first 100 characters)."""
    line = F.concat(F.lit("- ["), _or("source"), F.lit("] "), _or("title"), F.lit(": "), F.substring(_or("description"), 1, 100))
    return _lines(rows, keys, pos, line, "ΕΙΔΗΣΕΙΣ:", most)


def commits(rows: DataFrame, keys: Sequence[str], pos: str, most: int = 10) -> DataFrame:
    """From type, repo, created_at and payload (JSON): one line for each event."""
    get = lambda path: F.coalesce(F.get_json_object("payload", path), F.lit(""))
    kind = F.col("type")
    pushed = F.coalesce(F.size(F.from_json(F.get_json_object("payload", "$.commits"), "array<string>")), F.lit(0))
    detail = (
        F.when(kind == "PushEvent", F.concat(F.lit("Push: "), F.greatest(pushed, F.lit(0)).cast("string"), F.lit(" commit(s)")))
        .when(kind == "PullRequestEvent", F.concat(F.lit("PR: "), get("$.action"), F.lit(" — "), get("$.pull_request.title")))
        .when(kind == "IssuesEvent", F.concat(F.lit("Issue: "), get("$.action"), F.lit(" — "), get("$.issue.title")))
        .when(kind == "CreateEvent", F.concat(F.lit("Created "), get("$.ref_type"), F.lit(" "), get("$.ref")))
        .otherwise(F.regexp_replace(F.coalesce(kind, F.lit("")), "Event", ""))
    )
    date = F.coalesce(F.date_format(F.try_to_timestamp("created_at"), "d/M/yyyy"), F.lit(""))
    return _lines(rows, keys, pos, F.concat(F.lit("- "), date, F.lit(" ["), _or("repo"), F.lit("] "), detail), "GITHUB ACTIVITY:", most)


def weather(rows: DataFrame) -> DataFrame:
    """Adds context from a JSON answer in ``body``; a line says if it holds no data."""
    get = lambda path: F.get_json_object("body", path)
    whole = lambda path: F.round(get(path).cast("double")).cast("long").cast("string")
    text = F.concat(
        F.lit("ΚΑΙΡΟΣ:\nΠόλη: "), F.coalesce(get("$.name"), F.lit("Άγνωστη πόλη")), F.lit("\nΘερμοκρασία: "), whole("$.main.temp"), F.lit("°C (αισθητή: "),
        whole("$.main.feels_like"), F.lit("°C)\nΚαιρός: "), F.coalesce(get("$.weather[0].description"), F.lit("")), F.lit("\nΥγρασία: "), get("$.main.humidity"),
        F.lit("%\nΆνεμος: "), F.coalesce(get("$.wind.speed"), F.lit("0")), F.lit(" m/s"))
    return rows.withColumn("context", F.coalesce(text, F.lit("ΚΑΙΡΟΣ:\nΔεν βρέθηκαν δεδομένα καιρού.")))


def frame(context: Column, head: str, tail: str) -> Column:
    """Context between a heading and instructions; nothing for blank context."""
    trimmed = F.trim(F.coalesce(context, F.lit("")))
    return F.when(trimmed == "", "").otherwise(F.concat(F.lit(head + "\n"), trimmed, F.lit("\n" + tail)))


def missing_instruction(intent: Column, sources: Column, required: dict[str, str], instructions: dict[str, str]) -> Column:
    """The instruction for a required source that did not answer; empty if none is missing."""
    need = F.try_element_at(F.create_map(*(F.lit(x) for kv in required.items() for x in kv)), intent)
    say = F.try_element_at(F.create_map(*(F.lit(x) for kv in instructions.items() for x in kv)), intent)
    ok = F.exists(sources, lambda s: (s["name"] == need) & (s["status"] == "ok"))
    return F.when(need.isNull() | ok, "").otherwise(F.coalesce(say, F.lit("")))


def signals(events: DataFrame | None, mails: DataFrame | None, waiting: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Signals of calendar events (id, summary, starts_at), mails (id, summary, awaiting_reply) and a backlog (pending)."""
    parts = []
    if events is not None:
        parts.append(events.select(*keys, F.lit("calendar").alias("source"), _or("id").alias("key"), "summary", F.lit(3).alias("urgency"), F.col("starts_at").cast("timestamp").alias("occurs_at"), F.lit("").alias("detail")))
    if mails is not None:
        urgency = F.when(F.coalesce("awaiting_reply", F.lit(False)), 4).otherwise(2)
        parts.append(mails.select(*keys, F.lit("email").alias("source"), _or("id").alias("key"), "summary", urgency.alias("urgency"), F.lit(None).cast("timestamp").alias("occurs_at"), F.lit("").alias("detail")))
    if waiting is not None:
        n = F.col("pending").cast("string")
        parts.append(waiting.filter("pending > 0").select(*keys, F.lit("conversation").alias("source"), F.concat(F.lit("corrections-"), n).alias("key"), F.concat(n, F.lit(" διορθώσεις περιμένουν έλεγχο")).alias("summary"),
                                                          F.lit(2).alias("urgency"), F.lit(None).cast("timestamp").alias("occurs_at"), F.lit("από τη συνομιλία").alias("detail")))
    if not parts:
        raise ValueError("no source given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fact_check(response: Column, skills: str, languages: Sequence[str], age: int, companies: Sequence[str]) -> Column:
    """struct(passed, issues, cleaned): languages outside the skills, a wrong age, unknown companies.

    Sentences that name such a language are cut from ``cleaned``.
    """
    lowered, issues, cleaned = F.lower(response), [], response
    for name in languages:
        if name not in skills.lower():
            issues.append(F.when(F.contains(lowered, F.lit(name)), F.lit(f"Hallucinated skill: '{name.strip()}' not in identity")))
            escaped = "".join("\\" + c if c in r"+#.*?()[]{}|^$\\" else c for c in name.strip())
            cut = F.trim(F.regexp_replace(cleaned, rf"(?iU)[^.]*\b{escaped}\b[^.]*\.", ""))
            cleaned = F.when(F.contains(lowered, F.lit(name)), cut).otherwise(cleaned)
    said = F.regexp_extract(lowered, r"(\d{2})\s*(?:χρονων|χρονών|ετών|ετων)", 1)
    issues.append(F.when((said != "") & (said != str(age)), F.concat(F.lit("Wrong age: said "), said, F.lit(f", correct is {age}"))))
    named = F.regexp_extract_all(lowered, F.lit(r"(?U)(?:δουλεύω|δούλευα|εργάζομαι|εργαζόμουν)\s+(?:στην?|σε)\s+(\w+)"), 1)
    known = F.array(*(F.lit(c) for c in companies)).cast("array<string>")
    unknown = F.filter(named, lambda c: ~F.exists(known, lambda k: F.contains(c, k)))
    found = F.concat(F.array_compact(F.array(*issues)), F.transform(unknown, lambda c: F.concat(F.lit("Unknown company mentioned: '"), c, F.lit("'"))))
    return F.struct((F.size(found) == 0).alias("passed"), found.alias("issues"), F.when(F.size(found) == 0, response).otherwise(cleaned).alias("cleaned"))
