"""Intent, register, guardrails and context assembly, as expressions over a message or reply."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import alternation, capitalise_sentences, caseless, clean_name, fold, fold_text, let, may_hold, space_words, trim_to_words
from .privacy import redact_surnames, sanitise

#: A greeting with an optional form of address.
GREETING = (
    r"(?iU)^\s*(?:καλημ[εέ]ρα|καλησπ[εέ]ρα|καλην[υύ]χτα|καληνύχτα|γει[αά]\s*(?:σου|σας|χαρά)?|χαίρετε|χαιρετε|"
    r"hi|hello|hey|good\s+(?:morning|evening|afternoon))(?:\s+(?:σου|σας|ρε|βρε))?(?:\s+[α-ωά-ώa-z]{2,15})?\s*[,.!;:·—-]*\s*"
)
_EDGES = r"^[ ,.!;:·\-—]+|[ ,.!;:·\-—]+$"
LEAST, BOOST = 0.5, 0.1


def intent(message: Column, patterns=V.INTENT_PATTERNS, greeting: str = GREETING, boosted: str = "sensitive", default: str = "casual") -> Column:
    """struct(intent, confidence, keywords).

    The highest weight of a group's matching patterns is its score; ``boosted`` gains 0.1, up to
    1; the best group wins, the earlier on ties; under 0.5 the default at 0.5. A leading greeting
    is left out unless nothing else remains; an empty message is the default at 1. A pattern is only tried on
    a message that holds one of the literals that each of its matches has.
    """
    lowered = F.trim(F.lower(F.coalesce(message, F.lit(""))))
    rest = F.regexp_replace(F.regexp_replace(lowered, greeting, ""), _EDGES, "")
    text = F.when(rest != "", rest).otherwise(lowered)

    def judge(t: Column, plain: Column) -> Column:
        groups = []
        for order, (name, rules) in enumerate(patterns):
            rows = [F.when(may_hold(plain, p), F.struct(F.regexp_extract(t, f"(?iU){p}", 0).alias("k"), F.lit(float(w)).alias("w"), t.rlike(f"(?iU){p}").alias("hit"))) for p, w in rules]
            hits = F.filter(F.array(*rows), lambda h: h.isNotNull() & h["hit"])
            score = F.coalesce(F.array_max(F.transform(hits, lambda h: h["w"])), F.lit(0.0))
            if name == boosted:
                score = F.when(score > 0, F.least(score + BOOST, F.lit(1.0))).otherwise(0.0)
            groups.append(F.struct(score.alias("score"), F.lit(-order).alias("first"), F.lit(name).alias("intent"), F.transform(hits, lambda h: h["k"]).alias("keywords")))
        return F.array_max(F.array(*groups))

    best = let(text, lambda t: let(caseless(t), lambda plain: judge(t, plain)))
    none = F.array().cast("array<string>")
    result = lambda i, c, k: F.struct(i.alias("intent"), c.alias("confidence"), k.alias("keywords"))
    return F.when(lowered == "", result(F.lit(default), F.lit(1.0), none)).otherwise(
        F.element_at(F.transform(F.array(best), lambda b: F.when(b["score"] < LEAST, result(F.lit(default), F.lit(LEAST), none)).otherwise(result(b["intent"], b["score"], b["keywords"]))), 1)
    )


def explanation(result: Column) -> Column:
    """Why ``intent`` chose as it did; the first three keywords are named."""
    named = F.concat(F.lit("Matched "), result["intent"], F.lit(" patterns: "), F.array_join(F.slice(result["keywords"], 1, 3), ", "))
    empty = (result["confidence"] == 1) & (F.size(result["keywords"]) == 0)
    none = F.lit("No strong pattern match → casual (no retrieval)")
    return F.when(F.size(result["keywords"]) > 0, named).when(empty, F.lit("Empty message")).otherwise(none)


#: The branches of the router, in order.
ROUTES = ("sensitive", "personal", "knowledge", "casual", "memory", "schedule", "weather", "news", "devops")


def route(intent_: Column, routes: Sequence[str] = ROUTES) -> Column:
    """The branch (from 0) that an intent takes; null if it has none."""
    at = F.array_position(F.array(*map(F.lit, routes)), intent_)
    return F.when(at > 0, (at - 1).cast("int"))


def gate(on: bool | Column, value: Column, otherwise: Column | None = None) -> Column:
    """``value`` where the switch is on, else ``otherwise`` (null)."""
    on = F.lit(on) if isinstance(on, bool) else on
    return F.when(F.coalesce(on, F.lit(False)), value).otherwise(otherwise if otherwise is not None else F.lit(None))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first pattern that matches."""
    out = F.lit(default)
    for pattern, name in reversed(list(rules)):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def section_for(query: Column, sections: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """First section one of whose keywords occurs in the lower-cased query."""
    lowered, out = F.lower(query), F.lit(default)
    for name, keywords in reversed(list(sections)):
        hit = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(k.lower())) for k in keywords))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


#: Keywords of registers, in the order in which they are tried.
REGISTERS = {
    "academic": (
        "καθηγητης", "καθηγητρια", "επιβλεπων", "επιβλεπουσα", "εξεταστης", "επιτροπη", "μεταπτυχιακο", "διδακτορικο", "διπλωματικη",
        "πανεπιστημιο", "σχολη", "φοιτητης", "φοιτητρια", "ερευνητης", "professor", "supervisor", "phd", "msc", "ακαδημαικο",
    ),
    "professional": (
        "συναδελφος", "συναδελφη", "συνεργατης", "πελατης", "πελατισσα", "προισταμενος", "διευθυντης", "εργοδοτης", "αφεντικο", "manager",
        "recruiter", "hr", "client", "colleague", "boss", "δουλεια", "εταιρεια", "επαγγελματικα", "επιχειρηση", "προμηθευτης",
    ),
    "close": (
        "φιλος", "φιλη", "κολλητος", "κολλητη", "αδερφος", "αδερφη", "αδελφος", "αδελφη", "ξαδερφος", "ξαδερφη", "ξαδελφος",
        "μπαμπας", "πατερας", "μαμα", "μητερα", "γιαγια", "παππους", "θειος", "θεια", "οικογενεια", "συγγενης", "κοπελα", "συντροφος",
        "γκομενα", "παρεα", "συμμαθητης", "συγκατοικος",
    ),
}
FORMAL = ("academic", "professional")


def register(role: Column, registers: dict[str, Sequence[str]] = REGISTERS, default: str = "neutral") -> Column:
    """First register with a keyword equal to, or (from five letters) a prefix either way of, a word of the role."""
    tokens = F.regexp_extract_all(fold(F.coalesce(role, F.lit(""))), F.lit(r"(?U)[^\W\d_]+"), 0)
    out = F.lit(default)
    for name, keywords in reversed(list(registers.items())):
        known = [fold_text(k) for k in keywords]
        out = F.when(F.exists(tokens, _names_one_of(known)), F.lit(name)).otherwise(out)
    return out


def _names_one_of(known: list[str]):
    def hit(t: Column) -> Column:
        found = t.isin(*known)
        for k in known:
            if len(k) >= 5:
                found = found | ((F.length(t) >= 5) & (F.startswith(F.lit(k), t) | F.startswith(t, F.lit(k[:-1]))))
        return found

    return hit


def technical_question(message: Column, patterns: Sequence[str] = V.TECHNICAL_QUESTIONS) -> Column:
    return fold(F.coalesce(message, F.lit(""))).rlike("(?U)" + "|".join(fold_text(p) for p in patterns))


def system_prompt(parts: Sequence[Column], facts: Column, target_words: Column, least: int = 18) -> Column:
    """Lines of the prompt; facts only where the register leaves room for them."""
    return F.array_join(F.filter(F.array(*parts, F.when(target_words >= least, facts)), lambda p: p.isNotNull() & (p != "")), "\n")


#: Label, words aimed at, and instructions of each register.
REGISTER_STYLE = {
    "close": ("Κοντινό πρόσωπο", 6, "Μιλάς σε κοντινό σου άνθρωπο. Πολύ χαλαρά, σε δεύτερο ενικό. Μπορείς να είσαι αστείος ή απότομος, όπως με φίλο. Χωρίς εισαγωγές."),
    "professional": ("Επαγγελματική σχέση", 18, "Μιλάς σε επαγγελματικό πλαίσιο. Ευγενικά αλλά όχι τυπικά — δεύτερο ενικό, χωρίς πληθυντικό ευγενείας εκτός αν σου μιλήσουν έτσι. Απάντησε συγκεκριμένα και, αν χρειάζεται διευκρίνιση, ρώτησε. Χωρίς αργκό και χωρίς βωμολοχίες."),
    "academic": ("Ακαδημαϊκό πλαίσιο", 40, "Μιλάς σε ακαδημαϊκό πλαίσιο — καθηγητής, επιβλέπων ή εξεταστής. Σαφής και τεκμηριωμένος, στο πρώτο ενικό. Ολοκληρωμένες προτάσεις. Χωρίς αργκό, χωρίς βωμολοχίες, χωρίς υπερβολική οικειότητα. Αν δεν γνωρίζεις κάτι, πες το ευθέως αντί να το επινοήσεις."),
    "neutral": ("Άγνωστος", 15, "Δεν ξέρεις ποιος σου μιλάει. Φιλικά αλλά συγκρατημένα, σε δεύτερο ενικό. Μη μοιράζεσαι προσωπικές λεπτομέρειες που δεν θα έλεγες σε κάποιον που μόλις γνώρισες."),
}
#: The reminder after the facts, and the least words aimed at that take all facts.
REMINDER = (
    "ΥΠΕΝΘΥΜΙΣΗ: Τα παραπάνω είναι ΟΛΑ όσα ξέρεις για την υλοποίηση. Μην προσθέσεις εργαλείο, μοντέλο, πλατφόρμα ή αριθμό που δεν γράφεται εκεί, "
    "ούτε καν αν σου φαίνεται προφανές. Το «δεν το θυμάμαι ακριβώς» είναι σωστή απάντηση· ένα εργαλείο που δεν χρησιμοποίησες δεν είναι."
)
ALL_FACTS_FROM = 18


def prompt_for(register_: Column, name: Column, message: Column, identity: str, rules: str, facts: str = "", brief: str = "", styles=REGISTER_STYLE) -> Column:
    """The prompt for a listener: identity, who speaks, style, length, rules and, for formal registers or technical questions, facts.

    Registers that aim at ``ALL_FACTS_FROM`` words or more get all facts, others the brief ones.
    """
    tables = [F.create_map(*(F.lit(x) for k, v in styles.items() for x in (k, v[i]))) for i in range(3)]
    label, words, instructions = (F.try_element_at(t, register_) for t in tables)
    clean = clean_name(F.coalesce(name, F.lit("")))
    who = F.when(clean != "", F.concat(F.lit("ΣΥΝΟΜΙΛΗΤΗΣ: Σου μιλάει ο/η "), clean, F.lit(" — "), F.lower(label), F.lit(". Μπορείς να τον προσφωνήσεις με το όνομά του, χωρίς υπερβολή.")))
    evidence = F.when(words >= ALL_FACTS_FROM, F.lit(facts)).otherwise(F.lit(brief))
    grounded = (register_.isin(*FORMAL) | technical_question(message)) & (evidence != "")
    lines = F.array(
        F.lit(identity), who, F.concat(F.lit("ΥΦΟΣ: "), instructions),
        F.concat(F.lit("ΜΗΚΟΣ: Γύρω στις "), words.cast("string"), F.lit(" λέξεις. Μην ξεπερνάς αισθητά αυτό το μήκος.")), F.lit(rules),
        F.when(grounded, F.lit("")), F.when(grounded, evidence), F.when(grounded, F.lit(REMINDER)))
    return F.array_join(F.array_compact(lines), "\n")


# Guardrails -----------------------------------------------------------------------------------

#: Words around a removed name.
PLACEHOLDER = r"(?i)\s*\[(?:NAME|PERSON(?:_\d+)?|PHONE|EMAIL|IBAN|AFM|AMKA|URL|ID_CARD)\]\s*"
_ARTICLES = "ο|η|το|τον|την|του|της|τους|τις|οι|τα"
ORPHANS = (
    r"(?iU)(?:\b(?:στον|στην|στο|στου|στης|από\s+τον|απο\s+τον|με\s+τον|με\s+την|για\s+τον|για\s+την)|\b(?:ο|η|το|τον|την|του|της|τους|τις))\s+(?=[,.;!?·]|$|\s)",
    rf"(?iU)\b(?:{_ARTICLES})\s+(?=(?:{_ARTICLES}|για|από|απο|με|σε|προς|κατά|κατα|χωρίς|χωρις|είναι|ειναι|ήταν|ηταν|έχει|εχει|θα|να|και)\b)",
    r"(?iU)\b(?:με|από|απο|για|σε|προς|μαζί|μαζι)\s+(?:τον|την|το|του|της|τους|τις|τα|οι)\s+(?=(?:μετά|μετα|πριν|χθες|χτες|σήμερα|σημερα|αύριο|αυριο|τώρα|τωρα|αργότερα|αργοτερα)\b)",
)
#: What a pass over the gap can take away: each pass removes at least one of these, or is the last but one.
_REMOVABLE = rf"(?iU)\b(?:{_ARTICLES}|στον|στην|στο|στου|στης|με|από|απο|για|σε|προς|μαζί|μαζι)\b|[,·]"

#: Accented forms of vowels.
_ACCENTED = {"α": "ά", "ε": "έ", "η": "ή", "ι": "ίϊΐ", "ο": "ό", "υ": "ύϋΰ", "ω": "ώ"}


def any_accent(pattern: str) -> str:
    """The pattern with each unaccented vowel also standing for its accented forms."""
    return "".join(f"[{c}{_ACCENTED[c]}]" if c in _ACCENTED else c for c in pattern)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _seam(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+([,.;!?·])", "$1"), r"\s{2,}", " ")


def close_gap(text: Column) -> Column:
    """Remove articles and prepositions that lost their name, and tidy punctuation, until nothing changes.

    A removal can uncover the next orphan. The passes are as many as a text has words that could
    go; once a pass changes nothing the others do no work.
    """

    def tidied(t: Column) -> Column:
        for pattern in ORPHANS:
            t = F.regexp_replace(t, pattern, "")
        return F.regexp_replace(_seam(t), r"([,·])\s*([,.;!?·])", "$2")

    def step(now: Column, _: Column) -> Column:
        new = let(tidied(now["text"]), lambda t: F.struct(t.alias("text"), (t == now["text"]).alias("done")))
        return F.when(now["done"], now).otherwise(new)

    passes = F.sequence(F.lit(0), F.regexp_count(text, F.lit(_REMOVABLE)) + 1)
    start = F.struct(text.alias("text"), F.lit(False).alias("done"))
    closed = F.aggregate(passes, start, step, lambda now: now["text"])
    return _strip(F.regexp_replace(closed, r"^[\s,·]+", ""))


def strip_placeholders(text: Column) -> Column:
    return close_gap(_seam(F.regexp_replace(text, PLACEHOLDER, " ")))


def strip_vocatives(text: Column, patterns: Sequence[str] = V.VOCATIVES) -> Column:
    pattern = r"(?iU)\b(?:" + "|".join(any_accent(p) for p in patterns) + r")\b"
    return _strip(F.regexp_replace(_seam(F.regexp_replace(text, pattern, "")), r"^[\s,·]+", ""))


def strip_emoji_names(text: Column) -> Column:
    return _strip(F.regexp_replace(text, r"\([a-z_]+\)", ""))


def strip_leading_name(text: Column, names: Sequence[str] = V.LEADING_NAMES) -> Column:
    return F.regexp_replace(text, rf"(?iU)^(?:{'|'.join(names)})\s+", "")


def soften(text: Column, replacements: dict[str, str] = V.SOFTENED, blocked: Sequence[str] = V.BLOCKED_STEMS) -> Column:
    """Replace rude stems that have a mild form, then delete the others."""
    for stem, mild in replacements.items():
        text = F.regexp_replace(text, rf"(?iU)\b{any_accent(stem)}\w*", mild)
    text = F.regexp_replace(text, rf"(?iU)\b(?:{'|'.join(any_accent(b) for b in blocked)})\w*", "")
    return _strip(_seam(text))


def strip_impolite(text: Column, particles: Sequence[str] = V.IMPOLITE) -> Column:
    return F.regexp_replace(text, rf"(?iU)\b(?:{alternation(particles)})\b\s*", "")


def restore_accents(text: Column, spelling: dict[str, str] = V.ACCENTS) -> Column:
    """Whole words without accents get them (and lower case)."""
    table = F.create_map(*(F.lit(x) for kv in spelling.items() for x in kv))
    parts = F.regexp_extract_all(text, F.lit(r"(?sU)\w+|\W+"), 0)
    return F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t)), "")


def guard(text: Column, register_: Column | None = None, capitalise=True, accents=True, profanity=True, names=True, emoji=True, impolite=True) -> Column:
    """The whole chain; each step can be switched off, vocatives go in formal registers only."""
    out = strip_placeholders(text)
    if register_ is not None:
        out = F.when(register_.isin(*FORMAL), strip_vocatives(out)).otherwise(out)
    for on, step in ((emoji, strip_emoji_names), (names, strip_leading_name), (profanity, soften), (impolite, strip_impolite), (accents, restore_accents), (capitalise, capitalise_sentences)):
        out = step(out) if on else out
    return _strip(out)


def sanitise_output(text: Column, register_: Column | None = None, **surnames) -> Column:
    """Placeholders, surnames and formal vocatives; a second pass changes nothing."""
    out = strip_placeholders(text)
    redacted = redact_surnames(out, "", **surnames)
    out = F.when(redacted != out, close_gap(redacted)).otherwise(out)
    return F.when(register_.isin(*FORMAL), strip_vocatives(out)).otherwise(out) if register_ is not None else out


def guarded_reply(raw: Column, register_: Column | None = None, contacts: Sequence[str] = ()) -> Column:
    """struct(reply, pii_filtered): the guardrails, then the masks as a last defence; whether those changed anything."""
    return let(guard(raw, register_), lambda t: let(sanitise(t, contacts), lambda r: F.struct(r.alias("reply"), (r != t).alias("pii_filtered"))))


# Context from several sources -----------------------------------------------------------------

#: Words per source, all words, and the least worth adding.
SOURCE_BUDGET = {"identity": 0, "rag": 90, "calendar": 60, "email": 90, "weather": 25, "news": 60, "github": 50}
CONTEXT_BUDGET, LEAST_WORDS, OTHER_BUDGET = 220, 15, 60
#: Order of sources by intent, required source, sources useless without it.
PRIORITY = {
    "schedule": ("calendar", "rag", "email", "weather", "news", "github"),
    "memory": ("email", "rag", "calendar", "news", "github", "weather"),
    "knowledge": ("rag", "email", "calendar", "github", "news", "weather"),
    "devops": ("github", "rag", "email", "calendar", "news", "weather"),
    "weather": ("weather", "calendar", "rag", "email", "news", "github"),
    "news": ("news", "rag", "email", "calendar", "github", "weather"),
    "personal": ("rag", "github", "calendar", "email", "news", "weather"),
    "casual": ("rag", "calendar", "weather", "email", "news", "github"),
    "sensitive": (),
}
REQUIRED = {"schedule": "calendar", "memory": "email", "devops": "github", "weather": "weather", "news": "news"}
EXCLUDED_WITHOUT = {"schedule": ("rag",)}


def assemble_context(rows: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """request_id, context, sources, total_words, dropped from rows (request_id, intent, name, status, text).

    A request has one row for each source, so its rows meet safely in one fold: in the intent's
    order, each source gets the smaller of its budget and what is left, is skipped under 15 words,
    and skipping uses nothing up.
    """
    order = F.create_map(*(x for i, names in PRIORITY.items() for x in (F.lit(i), F.array(*map(F.lit, names)).cast("array<string>"))))
    budgets = F.create_map(*(F.lit(x) for kv in SOURCE_BUDGET.items() for x in kv))
    required = F.create_map(*(F.lit(x) for kv in REQUIRED.items() for x in kv))
    ranked = rows.withColumn("pos", F.array_position(F.try_element_at(order, F.col("intent")), F.col("name"))).filter("pos > 0")
    item = F.struct("pos", "name", "status", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    grouped = ranked.groupBy("request_id", "intent").agg(F.sort_array(F.collect_list(item)).alias("items"))
    primary = F.try_element_at(required, F.col("intent"))
    lost = ~F.exists("items", lambda x: (x["name"] == primary) & (x["status"] == "ok"))
    grouped = grouped.withColumn("lost", F.coalesce(lost, F.lit(True)))
    kind = "struct<name:string,status:string,words:int,block:string>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        barred = F.lit(False)
        for i, names in EXCLUDED_WITHOUT.items():
            barred = barred | ((F.col("intent") == i) & F.col("lost") & x["name"].isin(*names))
        allowance = F.least(F.coalesce(F.try_element_at(budgets, x["name"]), F.lit(OTHER_BUDGET)), F.lit(budget) - acc["used"])
        trimmed = trim_to_words(x["text"], allowance)
        n = F.size(space_words(trimmed))
        block = F.concat(F.lit("["), F.upper(x["name"]), F.lit("]\n"), trimmed)
        entry = lambda status, words, b: F.struct(x["name"].alias("name"), status.alias("status"), words.alias("words"), b.alias("block"))
        none = F.lit(None).cast("string")
        plain = entry(x["status"], F.lit(0), none)
        gone = entry(F.lit("dropped"), F.lit(0), none)
        bad = (x["status"] != "ok") | (x["text"] == "")
        new = F.when((x["status"] == "ok") & barred, gone).when(bad, plain).when(allowance < LEAST_WORDS, gone).otherwise(entry(F.lit("ok"), n, block))
        return F.struct((acc["used"] + new["words"]).alias("used"), F.array_append(acc["out"], new).alias("out"))

    folded = grouped.withColumn("f", F.aggregate("items", start, step))
    return folded.select(
        "request_id", "intent", F.array_join(F.filter(F.col("f.out.block"), lambda b: b.isNotNull()), "\n\n").alias("context"),
        F.transform(F.col("f.out"), lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"), x["words"].alias("words"))).alias("sources"),
        F.col("f.used").alias("total_words"), F.transform(F.filter(F.col("f.out"), lambda x: x["status"] == "dropped"), lambda x: x["name"]).alias("dropped"),
    )


def last_turns(turns: Column, most: int = 10) -> Column:
    """The last turns of an array, all if there are fewer."""
    return F.slice(turns, F.greatest(F.size(turns) - (most - 1), F.lit(1)), most)
