"""Checks of replies: denied statements, acronyms, corrupted names, unknown technologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import fold, fold_text, mentions, negated_before
from . import near_names


def denied(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Messages of the (pattern, message) rules that match the folded text without a negation before."""
    folded = fold(text)
    found = F.array(*(F.when(folded.rlike(f"(?U){p}") & ~negated_before(folded, f"(?U){p}"), F.lit(m)) for p, m in rules))
    return F.array_compact(found)


def acronyms(text: Column, expansions: dict[str, Sequence[str]] = V.ACRONYMS) -> Column:
    """A message for each acronym that is given a gloss without one of the accepted wordings.

    A gloss stands in brackets, or after a word for "means"; an acronym without one is fine.
    """
    issues = []
    for short, accepted in expansions.items():
        between = rf"(?iU)\b{short}\b[\s?:,–—-]*(?:\(([^)]{{3,60}})\)|(?:για|=|είναι|ειναι|σημαίνει|σημαινει)\s+([^.!?;]{{3,60}}))"
        part = lambda k, p=between: F.regexp_extract(text, p, k)
        gloss = F.lower(F.concat(part(1), part(2)))
        good = F.lit(False)
        for a in accepted:
            good = good | F.contains(gloss, F.lit(a))
        message = F.concat(F.lit(f"Το {short} δεν σημαίνει «"), F.trim(gloss), F.lit(f"» — είναι {accepted[0]}"))
        issues.append(F.when((gloss != "") & ~good, message))
    return F.array_compact(F.array(*issues))


def canonical_name(token: Column, vocabulary: Sequence[str]) -> Column:
    """A listed name, with or without separators and version; empty if it is none."""
    plain = F.regexp_replace(F.lower(token), r"[.\-_]", "")
    bare = F.regexp_replace(F.regexp_replace(F.lower(token), r"[-._]?\d+(?:\.\d+)*[a-z]?\z", ""), r"[.\-_]", "")
    known = [v.lower() for v in vocabulary]
    return F.when(plain.isin(*known), plain).when(bare.isin(*known), bare).otherwise(F.lit(""))


def unsupported_names(text: Column, facts: Column, vocabulary: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """Names of the vocabulary that the text mentions and the facts don't."""
    folded_text_, folded_facts = fold(text), fold(facts)
    out = []
    for name in vocabulary:
        known = mentions(name, folded_facts)
        for alias, target in (aliases or {}).items():
            if target == name:
                known = known | mentions(alias, folded_facts)
        out.append(F.when(mentions(name, folded_text_) & ~F.coalesce(known, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*out))


def corrupted_names(rows: DataFrame, text: str, names: Sequence[str] | DataFrame, least: int = 5, ratio: float = 0.85) -> DataFrame:
    """token, name, ratio: near misses of known names (a list, or a table (name)) among the distinct tokens of all rows.

    Tokens shorter than ``least`` and known names themselves do not count. Candidates come from an equality
    join on parts of names; only the few that are left are measured in Arrow batches.
    """
    if not isinstance(names, DataFrame):
        names = rows.sparkSession.createDataFrame([(n,) for n in sorted({*names})], "name string")
    lowered = names.select(F.lower("name").alias("name")).filter("name <> ''").distinct()
    # A name shorter than this is near no token that counts.
    long = lowered.filter(F.length("name") * (2 - ratio) / ratio >= least - 1e-9)
    tokens = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w.-]+"), 0)).alias("token")).filter(F.length("token") >= least).distinct()
    some = tokens.join(lowered.withColumnRenamed("name", "token"), "token", "left_anti")
    return near_names.measured(near_names.candidates(some, long, ratio), ratio)


def verdict(reply: Column, problems: Column, hits: Column, expected: int, refusal: str) -> Column:
    """struct(accuracy, answered): refusal, else confabulated with problems, else clean."""
    accuracy = F.when(F.contains(reply, F.lit(refusal)), "refusal").when(F.size(problems) > 0, "confabulated").otherwise("clean")
    return F.struct(accuracy.alias("accuracy"), (F.size(hits) >= min(1, expected)).alias("answered"))


def unusable(reply: Column, refused: Column, problems: Column, expected: Sequence[str], least: int = 5) -> Column:
    """Why a reply is no sample; null if it is one."""
    folded = fold(reply)
    hit = F.lit(not expected)
    for e in expected:
        hit = hit | F.contains(folded, F.lit(fold_text(e)))
    return (
        F.when(F.trim(reply) == "", "empty").when(refused, "refusal").when(F.size(problems) > 0, "problems")
        .when(~hit, "expected term missing").when(F.size(F.split(F.trim(reply), r"\s+")) < least, "too short")
    )


def without_sentences(text: Column, pattern: str) -> Column:
    """The text without the sentences that match."""
    kept = F.filter(F.split(text, r"(?<=[.!;?])\s+"), lambda s: ~s.rlike(pattern))
    return F.array_join(kept, " ")


def asserts(reply: Column, pattern: str) -> Column:
    """Whether a sentence that is no question matches."""
    parts = F.split(reply, r"(?<=[.!;?·])\s+|\n+")
    return F.exists(parts, lambda s: s.rlike(pattern) & ~F.trim(s).rlike(r"[;?]\z"))


def without_schedule_claims(reply: Column, intent: Column, calendar_read: Column, message: Column, claim: str, presupposes: str = V.PRESUPPOSES_EVENT,
                            refusal: str = V.SCHEDULE_REFUSAL, ask: str = V.SCHEDULE_ASK_WHICH, schedule: str = "schedule") -> Column:
    """struct(text, replaced): a reply that claims something of a calendar that was not read becomes a refusal.

    Only for the intent ``schedule``; a sentence that asks is no claim (see ``asserts``). Where the message takes an
    event for granted, the reply asks which one. Both patterns look at folded texts, in either case. Nulls claim nothing.
    """
    claimed = (intent == schedule) & ~F.coalesce(calendar_read, F.lit(False)) & asserts(fold(reply), f"(?iU){claim}")
    claimed = F.coalesce(claimed, F.lit(False))
    instead = F.when(fold(F.coalesce(message, F.lit(""))).rlike(f"(?iU){presupposes}"), ask).otherwise(refusal)
    return F.struct(F.when(claimed, instead).otherwise(reply).alias("text"), claimed.alias("replaced"))
