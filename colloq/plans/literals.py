"""Queries over texts and items that the tables lack: literals dealt to the turns, lines of fetched items, checks of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times, vectors
from ..operators import agency, claims, dataset, formats, medallion, metrics, privacy, search
from ..session import scratch, table
from .catalog import expected, given, literal, long, query, r6

# Lines of fetched items -----------------------------------------------------------------------


def _lines_sql(head: str, line: str, most: int) -> str:
    return f"""with r as (select *, row_number() over (partition by conv_id order by turn) as k from conversations)
select conv_id, '{head}' || chr(10) || string_agg({line}, chr(10) order by turn) as context from r where k <= {most} group by conv_id"""


def _turns(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", *(c.alias(name) for name, c in columns.items()))


def _user() -> Column:
    return F.col("role") == "user"



@query(_lines_sql("ΠΡΟΓΡΑΜΜΑ:", "'- ' || turn || ' → ' || (turn + 1) || ': ' || case when role = 'user' then 'Χωρίς τίτλο' else role end || case when turn % 2 = 0 then ' (room ' || turn || ')' else '' end", 10))
def calendar_lines(spark, sf):
    turn = F.col("turn")
    rows = _turns(spark, sf, start=turn.cast("string"), end=(turn + 1).cast("string"), title=F.when(_user(), "").otherwise(F.col("role")), location=F.when(turn % 2 == 0, F.concat(F.lit("room "), turn.cast("string"))))
    return formats.calendar(rows, ["conv_id"], "turn")


@query(_lines_sql("ΔΙΑΘΕΣΙΜΟΤΗΤΑ:", "'- slot ' || turn", 5))
def free_slot_lines(spark, sf):
    return formats.free_slots(_turns(spark, sf, slot=F.concat(F.lit("slot "), F.col("turn").cast("string"))), ["conv_id"], "turn")


@query(_lines_sql("ΕΙΔΗΣΕΙΣ:", "'- [' || role || '] ' || 'about ' || turn || ': ' || substr(text, 1, 100)", 5))
def news_lines(spark, sf):
    rows = _turns(spark, sf, source=F.col("role"), title=F.concat(F.lit("about "), F.col("turn").cast("string")), description=F.col("text"))
    return formats.news(rows, ["conv_id"], "turn")


_EVENTS = (
    ("PushEvent", '{"commits": ["a", "b"]}', "Push: 2 commit(s)"), ("PullRequestEvent", '{"action": "opened", "pull_request": {"title": "T"}}', "PR: opened — T"),
    ("IssuesEvent", '{"action": "closed", "issue": {"title": "I"}}', "Issue: closed — I"), ("CreateEvent", '{"ref_type": "branch", "ref": "x"}', "Created branch x"), ("WatchEvent", "{}", "Watch"),
)


@query(_lines_sql("GITHUB ACTIVITY:", f"'- ' || (1 + turn % 9) || '/3/2024 [' || role || '] ' || [{', '.join(chr(39) + e[2] + chr(39) for e in _EVENTS)}][(conv_id + turn) % 5 + 1]", 10))
def commit_lines(spark, sf):
    created = F.format_string("2024-03-%02dT10:00:00Z", 1 + F.col("turn") % 9)
    rows = _turns(spark, sf, type=literal([e[0] for e in _EVENTS]), payload=literal([e[1] for e in _EVENTS]), repo=F.col("role"), created_at=created)
    return formats.commits(rows, ["conv_id"], "turn")


_WEATHER = {
    '{"name": "X", "main": {"temp": 20.6, "feels_like": 19.2, "humidity": 40}, "weather": [{"description": "clear"}], "wind": {"speed": 3.5}}':
        "ΚΑΙΡΟΣ:\nΠόλη: X\nΘερμοκρασία: 21°C (αισθητή: 19°C)\nΚαιρός: clear\nΥγρασία: 40%\nΆνεμος: 3.5 m/s",
    "{}": "ΚΑΙΡΟΣ:\nΔεν βρέθηκαν δεδομένα καιρού.", "broken": "ΚΑΙΡΟΣ:\nΔεν βρέθηκαν δεδομένα καιρού.",
}


@query(expected(context=_WEATHER.values()))
def weather_lines(spark, sf):
    rows = given(spark, sf, list(_WEATHER)).withColumnRenamed("text", "body")
    return formats.weather(rows).select("conv_id", "turn", "context")


_FRAMES = {"  a b ": "HEAD\na b\nTAIL", "   ": "", "": "", "x": "HEAD\nx\nTAIL"}


@query(expected(framed=_FRAMES.values()))
def framed_contexts(spark, sf):
    return given(spark, sf, list(_FRAMES)).select("conv_id", "turn", formats.frame(F.col("text"), "HEAD", "TAIL").alias("framed"))


@query("select conv_id, turn, case when turn % 3 = 0 and role = 'user' then 'say calendar' when turn % 3 = 1 and role <> 'user' then 'say mail' else '' end as instruction from conversations")
def missing_sources(spark, sf):
    """The calendar answers all but users, mail only them."""
    status = lambda name, ok: F.struct(F.lit(name).alias("name"), F.when(ok, "ok").otherwise("failed").alias("status"))
    sources = F.array(status("calendar", ~_user()), status("email", _user()))
    intent = F.element_at(F.array(*map(F.lit, ("schedule", "mail", "casual"))), (F.col("turn") % 3 + 1).cast("int"))
    say = formats.missing_instruction(intent, sources, {"schedule": "calendar", "mail": "email"}, {"schedule": "say calendar", "mail": "say mail"})
    return table(spark, sf, "conversations").select("conv_id", "turn", say.alias("instruction"))


@query("""select user_id, 'calendar' as source, event_id::varchar as key, event_type as summary, 3::int as urgency, ts as occurs_at, '' as detail from events
union all select user_id, 'email', event_id::varchar, event_type, case when event_id % 2 = 0 then 4 else 2 end, null, '' from events
union all select user_id, 'conversation', 'corrections-' || n, n || ' διορθώσεις περιμένουν έλεγχο', 2, null, 'από τη συνομιλία'
from (select user_id, count(*) filter (event_id % 5 = 0) as n from events group by user_id) where n > 0""")
def source_signals(spark, sf):
    e = table(spark, sf, "events")
    items = e.select("user_id", F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("summary"), F.col("ts").alias("starts_at"), (F.col("event_id") % 2 == 0).alias("awaiting_reply"))
    waiting = e.groupBy("user_id").agg(F.count_if(F.col("event_id") % 5 == 0).alias("pending"))
    out = formats.signals(items, items, waiting, ["user_id"])
    return out.withColumn("occurs_at", F.col("occurs_at").cast("timestamp_ntz"))


@query("""with s as (select event_id, user_id, 'system:' || substr(sha256(event_type), 1, 16) as identity, event_type from events)
select user_id, event_id, identity from s where not (user_id % 2 = 0 and event_type = 'click')
qualify row_number() over (partition by user_id, identity order by event_id) = 1""")
def unsaid_signals(spark, sf):
    """Every other user has heard of clicks already."""
    e = table(spark, sf, "events")
    signals = e.select("event_id", "user_id", F.lit("system").alias("source"), F.lit("").alias("key"), F.col("event_type").alias("summary"))
    heard = e.filter("user_id % 2 = 0").select("user_id").distinct().withColumn("identity", agency.identity(F.lit("system"), F.lit(""), F.lit("click")))
    return agency.dedupe(signals, ["user_id"], "event_id", heard).select("user_id", "event_id", "identity")


# Checks of replies ----------------------------------------------------------------------------

_FACTS = {
    "Γράφω Rust. Και Python.": ("Hallucinated skill: 'rust' not in identity", "Και Python."), "Είμαι 30 ετών": ("Wrong age: said 30, correct is 26", "Είμαι 30 ετών"),
    "Είμαι 26 ετών": ("", "Είμαι 26 ετών"), "δουλεύω στη Microsoft": ("Unknown company mentioned: 'microsoft'", "δουλεύω στη Microsoft"), "δουλεύω στη nova": ("", "δουλεύω στη nova"),
}


@query(expected(issues=[i for i, _ in _FACTS.values()], cleaned=[c for _, c in _FACTS.values()], passed=[not i for i, _ in _FACTS.values()]))
def fact_checks(spark, sf):
    c = formats.fact_check(F.col("text"), "python, sql", ["rust"], 26, ["nova"])
    rows = given(spark, sf, list(_FACTS)).select("conv_id", "turn", c.alias("c"))
    return rows.select("conv_id", "turn", F.array_join("c.issues", "|").alias("issues"), "c.cleaned", "c.passed")


_ASSERTED = {"Είμαι σπίτι. Θα έρθεις;": True, "Είσαι σπίτι;": False, "Καλά.\nσπίτι μου": True, "τίποτα": False}
_NEGATED = {"δεν είναι docker": True, "δεν ξέρω. είναι docker": False, "nothing": False, "χωρίς docker": True}


@query(expected(asserted=_ASSERTED.values(), negated=_NEGATED.values()))
def asserted_or_negated(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", claims.asserts(literal(list(_ASSERTED)), "σπίτι").alias("asserted"), T.negated_before(literal(list(_NEGATED)), "docker").alias("negated"))


@query("select * from (values ('databriks', 'databricks'), ('dockeer', 'docker')) v(token, name) where exists (select 1 from conversations having count(*) >= 4)")
def corrupted_names(spark, sf):
    rows = given(spark, sf, ["use databriks now", "with dockeer", "Docker runs", "far from anything"])
    return claims.corrupted_names(rows, "text", ["Databricks", "docker"]).select("token", "name")


# Masks ----------------------------------------------------------------------------------------

_CONTACTS = {"είδα τον Νίκο χθες": "είδα τον [ΟΝΟΜΑ] χθες", "ο ΝΙΚΟΣ ήρθε": "ο [ΟΝΟΜΑ] ήρθε", "της Μαρίας": "της [ΟΝΟΜΑ]", "τίποτα": "τίποτα"}


@query(expected(text=_CONTACTS.values(), changed=[a != b for a, b in _CONTACTS.items()]))
def sanitised_records(spark, sf):
    return privacy.sanitise_records(given(spark, sf, list(_CONTACTS)), ["text", "turn"], ["Νίκος", "Μαρία"])


_SURNAMES = {"ο Παπαδόπουλος ήρθε": "ο [SURNAME] ήρθε", "η Αβγουλά και όλοι": "η Αβγουλά και όλοι", "Tsakalos eats": "[SURNAME] eats", "ναι": "ναι"}


def _clean_surnames(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "clean")
    privacy.clean_verified(given(spark, sf, list(_SURNAMES)), ["text"], path, gazetteer=("tsakal",))
    return spark.read.schema("conv_id long, turn long, text string").json(path)


@query(expected(text=_SURNAMES.values()))
def verified_surnames(spark, sf):
    """Redacted, scanned again, written and read."""
    return _clean_surnames(spark, sf)


# Times, numbers, search, training sets --------------------------------------------------------


@query("select event_id, date_trunc('second', ts) as seconds, date_trunc('millisecond', ts) as millis from events")
def epoch_times(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    at = lambda v: times.epoch_time(v).cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", at(F.floor(micros / 1_000_000)).alias("seconds"), at(F.floor(micros / 1000)).alias("millis"))


@query("select event_id, round_even(event_id / 8, 2)::double as rounded from events")
def half_even(spark, sf):
    return table(spark, sf, "events").select("event_id", metrics.rounded(F.col("event_id") / 8, 2).alias("rounded"))


@query("""select event_id, (case when ts < timestamp '2024-01-20 12:00:00' then 0.2 when ts <= timestamp '2024-01-20 13:00:00' then 1.5
when ts <= timestamp '2024-01-20 20:00:00' then 1.0 when ts <= timestamp '2024-01-21 12:00:00' then 0.7 else 0.3 end)::double as decay from events""")
def time_decays(spark, sf):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", times.time_decay(F.col("ts"), now).alias("decay"))


@query("select item_id, true as translated, 16::bigint as width, true as leg_only from benchmark")
def embedded_queries(spark, sf):
    """The vector of the translated query, while the query itself stays."""
    translate = lambda c: F.concat(F.lit("in other words: "), c)
    asked = search.embedded_queries(table(spark, sf, "benchmark").withColumn("query", F.col("text")), medallion.hash_embedding, translate)
    same = F.col("vector") == medallion.hash_embedding(translate(F.col("text")))
    return asked.select("item_id", same.alias("translated"), long(F.size("vector")).alias("width"), (F.col("query") == F.col("text")).alias("leg_only"))


@query("""with v as (select vec_id, embedding::double[] as e from embeddings) select vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) as norm,
round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * i)), 6) as weighed from v""")
def vector_norms(spark, sf):
    e = vectors.doubles(F.col("embedding"))
    steps = F.transform(F.sequence(F.lit(1), F.size(e)), lambda i: i.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", r6(vectors.norm(e)).alias("norm"), r6(vectors.dot(e, steps)).alias("weighed"))


@query("select conv_id, turn, case when turn % 3 = 0 then 'no_corpus_configured' when turn % 3 = 1 then 'corpus_missing' else 'ok' end as status, (8 * turn * 2)::bigint as batch from conversations")
def search_status(spark, sf):
    names = F.array(F.lit(search.status(None, False)), F.lit(search.status("p", False)), F.lit(search.status("p", True)))
    batch = long(F.col("turn") * dataset.effective_batch(4, 2, 2))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.element_at(names, (F.col("turn") % 3 + 1).cast("int")).alias("status"), batch.alias("batch"))


_MODELS = {"mistralai/Mistral-7B": "mistral", "Mixtral-8x7B": "mistral", "meta-llama/Llama-3-8B": "llama3", "": "llama3"}


@query(f"""select m.conv_id, m.turn, m.format, '<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || c.text
|| '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || c.role || '<|eot_id|>' as llama, 'user:' || c.text || '|assistant:' || c.role as turns
from ({expected(format=_MODELS.values())}) m join conversations c on c.conv_id = m.conv_id and c.turn = m.turn""")
def chat_formats(spark, sf):
    said = F.transform(dataset.messages(F.col("text"), F.col("role")), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", dataset.chat_format(literal(list(_MODELS))).alias("format"), dataset.template(F.col("text"), F.col("role")).alias("llama"), F.array_join(said, "|").alias("turns"))
