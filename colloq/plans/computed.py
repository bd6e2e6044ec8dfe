"""Checks and masks of Greek text over the tables' own texts: the same operators with Latin parameters, and SQL that computes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import claims, conversation, privacy
from ..session import scratch, table
from .catalog import query, r6

_FOLDED = "replace(strip_accents(lower({})), 'ß', 'ss')"
_SENTENCES = "string_split(regexp_replace(regexp_replace({}, '([.!;?·])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"
_REFUSAL, _ASK = "cannot see it", "which one"


@query(f"""with t as (select *, {_FOLDED.format("text")} as f, lag(text) over (partition by conv_id order by turn) as message from conversations),
s as (select *, len(list_filter({_SENTENCES.format("f")}, lambda x: regexp_matches(x, 'the|ando') and not regexp_matches(trim(x), '[;?]$'))) > 0 as asserts from t),
c as (select *, coalesce(role = 'assistant' and conv_id % 4 <> 0 and asserts, false) as replaced from s)
select conv_id, turn, replaced, case when not replaced then text when regexp_matches({_FOLDED.format("coalesce(message, '')")}, 'ing|que') then '{_ASK}' else '{_REFUSAL}' end as text from c""")
def replaced_schedules(spark, sf):
    """Assistant turns as replies to the turn before; the calendar of every fourth conversation was read."""
    rows = table(spark, sf, "conversations").withColumn("message", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    intent = F.when(F.col("role") == "assistant", "schedule").otherwise("casual")
    c = claims.without_schedule_claims(F.col("text"), intent, F.col("conv_id") % 4 == 0, F.col("message"), "the|ando", "ing|que", _REFUSAL, _ASK)
    return rows.select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.replaced", "c.text")


#: Letters that the texts hold, so that SQL finds the first match as a plain substring.
_RULES = (("the", "m1"), ("ion", "m2"), ("que", "m3"))
_WINDOW = "substr(f, greatest(strpos(f, '{0}') - 60, 1)::bigint, (strpos(f, '{0}') - greatest(strpos(f, '{0}') - 60, 1))::bigint)"
_NEGATION = "regexp_matches(list_last(string_split(translate({}, '!?;·', '....'), '.')), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(δεν|χωρισ|χωρις)([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"


@query(f"""with t as (select conv_id, turn, replace(translate({_FOLDED.format("case turn % 3 when 0 then 'δεν ' || text when 1 then 'Χωρίς. ' || text else text end")}, 'ς', 'σ'), 'ß', 'ss') as f from conversations)
select conv_id, turn, array_to_string(list_filter([{", ".join(f"case when contains(f, '{p}') and not {_NEGATION.format(_WINDOW.format(p))} then '{m}' end" for p, m in _RULES)}], lambda x: x is not null), '|') as denied from t""")
def denied_turns(spark, sf):
    """Two of three turns have a negation before them, one of these in a sentence of its own."""
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("δεν "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Χωρίς. "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(claims.denied(t, _RULES), "|").alias("denied"))


_NAMES = ("the", "in.g", "de-la", "que", "of")


@query(f"""with t as (select unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+')) as token from documents),
n as (select lower(token) as token, count(*)::bigint as n from t group by 1),
c as (select n, regexp_replace(token, '[.\\-_]', '', 'g') as plain, regexp_replace(regexp_replace(token, '[-._]?[0-9]+(?:\\.[0-9]+)*[a-z]?$', ''), '[.\\-_]', '', 'g') as bare from n)
select case when plain in {_NAMES} then plain when bare in {_NAMES} then bare else '' end as name, sum(n)::bigint as n from c group by 1""")
def canonical_tokens(spark, sf):
    """Tokens by the listed name that they are with or without separators and version."""
    tokens = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._-]+"), 0)).alias("token"))
    return tokens.groupBy(claims.canonical_name(F.col("token"), _NAMES).alias("name")).agg(F.count("*").alias("n"))


@query(f"""select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: case
when length({_FOLDED.format("w")}) >= 5 and (starts_with({_FOLDED.format("w")}, 'stati') or ({_FOLDED.format("w")} not in ('station', 'action') and not ends_with({_FOLDED.format("w")}, 'ing')
and ends_with({_FOLDED.format("w")}, 'tion'))) then '[SURNAME]' else w end), '') as text from documents""")
def verified_documents(spark, sf):
    """Masked documents, published only after their files were scanned; read back from there."""
    path = scratch(spark, "verified")
    lists = {"gazetteer": ("stati",), "suffixes": ("tion",), "adjectival": ("ing",), "ordinary": ("station",), "places": ("action",)}
    privacy.clean_verified(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], path, **lists)
    return spark.read.schema("doc_id long, text string").json(path)


#: Letters beyond ASCII become underscores, so that RE2's word boundaries fall as they do among all letters.
_ASCII = "regexp_replace({}, '[À-ÖØ-öø-ɏͰ-Ͽἀ-῿]', '_', 'g')"


def _intent_sql(patterns, boosted: str = "sensitive") -> str:
    """Every pattern of every group in SQL: the best group, its confidence, and what its patterns found."""
    scores, words, pick, found = [], [], "", ""
    quoted = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    for k, (name, rules) in enumerate(patterns):
        best = f"greatest({', '.join(f'case when regexp_matches(t, {quoted(p)}) then {w} else 0 end' for p, w in rules)}, 0)"
        scores.append(f"case when {best} > 0 then least({best} + {0.1 if name == boosted else 0}, 1.0) else 0 end as s{k}")
        hits = ", ".join(f"case when regexp_matches(t, {quoted(p)}) then regexp_extract(t, {quoted(p)}) end" for p, _ in rules)
        words.append(f"array_to_string(list_filter([{hits}], lambda x: x is not null), '|') as k{k}")
        pick += f" when s{k} = best then '{name}'"
        found += f" when s{k} = best then k{k}"
    greeting = conversation.GREETING.replace("(?iU)", "(?i)")
    edges = "regexp_replace({}, '^[ ,.!;:·—-]+|[ ,.!;:·—-]+$', '', 'g')"
    return f"""with l as (select conv_id, turn, trim(lower(coalesce(text, ''))) as lowered from conversations),
g as (select *, {edges.format(f"regexp_replace(lowered, '{greeting}', '', 'g')")} as rest from l),
x as (select *, {_ASCII.format("case when rest <> '' then rest else lowered end")} as t from g),
s as (select *, {', '.join(scores)}, {', '.join(words)} from x),
c as (select *, lowered = '' as empty, greatest({', '.join(f's{k}' for k in range(len(patterns)))}) as best from s)
select conv_id, turn, case when empty or best < 0.5 then 'casual'{pick} end as intent,
round((case when empty then 1 when best < 0.5 then 0.5 else best end)::double, 6) as confidence,
case when empty or best < 0.5 then ''{found} end as keywords from c"""


def _intents(spark, sf, patterns):
    i = conversation.intent(F.col("text"), patterns)
    return table(spark, sf, "conversations").select("conv_id", "turn", i.alias("i")).select(
        "conv_id", "turn", "i.intent", r6(F.col("i.confidence")).alias("confidence"), F.array_join("i.keywords", "|").alias("keywords"))


@query(_intent_sql(V.INTENT_PATTERNS))
def intent_full_tables(spark, sf):
    """The full pattern tables over all turns."""
    return _intents(spark, sf, V.INTENT_PATTERNS)


#: A Latin pattern or two for each branch of the router.
_NINE = (
    ("sensitive", ((r"\bhe\b", 0.8),)), ("personal", ((r"\bthat\b", 0.9), (r"ndly\b", 0.75))), ("knowledge", ((r"\bwith\b", 0.85), (r"stion", 0.7))),
    ("memory", ((r"\bdes?\b", 0.9),)), ("schedule", ((r"\band\b", 0.8), (r"\bund\b", 0.9))), ("weather", ((r"\bin\b", 0.7),)),
    ("news", ((r"\bis\b", 0.85),)), ("devops", ((r"\bto\b", 0.75), (r"ción", 0.9))), ("casual", ((r"^[a-e]", 0.6),)),
)
_ROUTED = "list_position(['sensitive', 'personal', 'knowledge', 'casual', 'memory', 'schedule', 'weather', 'news', 'devops'], intent) - 1"


@query(f"select conv_id, turn, intent, confidence, ({_ROUTED})::int as branch from ({_intent_sql(tuple((n, tuple((p.replace('ción', 'ci_n'), w) for p, w in r)) for n, r in _NINE))})")
def nine_routes(spark, sf):
    """Every branch of the router, by patterns that the texts hold."""
    found = _intents(spark, sf, _NINE)
    return found.select("conv_id", "turn", "intent", "confidence", conversation.route(F.col("intent")).alias("branch"))
