"""Masking of structured identifiers, contacts and morphological names; leak gates.

Masks are chained expressions in one projection; names are judged token by token, so no offsets
are needed and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import alternation, fold, fold_text, let, strip_accents
from ..sources import publish

#: Placeholders and patterns, in the order in which they are applied.
PLACEHOLDERS = {
    "iban": "[IBAN]", "amka": "[ΑΜΚΑ]", "afm": "[ΑΦΜ]", "id_card": "[ΤΑΥΤΟΤΗΤΑ]",
    "phone": "[ΤΗΛΕΦΩΝΟ]", "email": "[EMAIL]", "name": "[ΟΝΟΜΑ]",
}
IBAN = r"(?iU)\bGR\d{2}(?:\s?\d){23}\b"
ID_CARD = r"(?U)\b[ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏΪΫ]{1,2}\s?\d{6}\b"
PHONE = r"(?<!\d)(?:\+30\s?)?(?:69\d{2}\s?\d{3}\s?\d{3}|2\d{9})(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
FULL_NAME = r"(?U)\b[ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏΪΫ][αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ]{2,}"


def valid_afm(digits: Column) -> Column:
    """Nine digits whose weighted sum modulo 11, modulo 10, is the last."""
    total = sum((F.substring(digits, i + 1, 1).cast("int") * 2 ** (8 - i) for i in range(8)), F.lit(0))
    return F.when(digits.rlike(r"^[0-9]{9}\z"), F.pmod(F.pmod(total, F.lit(11)), F.lit(10)) == F.substring(digits, 9, 1).cast("int")).otherwise(F.lit(False))


def valid_amka(digits: Column) -> Column:
    """Eleven digits that begin with day and month of a leap year."""
    day = F.try_to_timestamp(F.concat(F.lit("2000"), F.substring(digits, 3, 2), F.substring(digits, 1, 2)), F.lit("yyyyMMdd"))
    return F.when(digits.rlike(r"^[0-9]{11}\z"), day.isNotNull()).otherwise(F.lit(False))


def mask_tokens(text: Column, token: str, other: str, judge, placeholder: str) -> Column:
    """Replace the tokens that ``judge`` accepts; ``token|other`` must cover any text."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s){token}|{other}"), 0)
    return F.array_join(F.transform(parts, lambda t: F.when(judge(t), F.lit(placeholder)).otherwise(t)), "")


def count_tokens(text: Column, token: str, judge) -> Column:
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(token), 0), judge))


def _digits_mask(text: Column, n: int, valid, placeholder: str) -> Column:
    return mask_tokens(text, r"(?U)\w+", r"\W+", lambda t: F.when(t.rlike(rf"^\d{{{n}}}\z"), valid(t)).otherwise(F.lit(False)), placeholder)


def mask(text: Column, category: str, placeholder: str | None = None) -> Column:
    """One structured category; each pass of ``sanitise`` sees what the one before left."""
    p = placeholder if placeholder is not None else PLACEHOLDERS[category]
    if category == "amka":
        return _digits_mask(text, 11, valid_amka, p)
    if category == "afm":
        return _digits_mask(text, 9, valid_afm, p)
    return F.regexp_replace(text, {"iban": IBAN, "id_card": ID_CARD, "phone": PHONE, "email": EMAIL}[category], p)


def count(text: Column, category: str) -> Column:
    if category in ("amka", "afm"):
        n, valid = (11, valid_amka) if category == "amka" else (9, valid_afm)
        return count_tokens(text, r"(?U)\w+", lambda t: F.when(t.rlike(rf"^\d{{{n}}}\z"), valid(t)).otherwise(F.lit(False)))
    return F.regexp_count(text, F.lit({"iban": IBAN, "id_card": ID_CARD, "phone": PHONE, "email": EMAIL}[category]))


def name_variants(name: str, non_names: Sequence[str] = V.NON_NAMES) -> set[str]:
    """Declined forms of a contact's words, with and without accents."""
    out: set[str] = set()
    for word in name.split():
        if len(word) < 3:
            continue
        forms = {word}
        if word.endswith(("ος", "ός")):
            stem = word[:-2]
            accent = word[-2] == "ό"
            forms |= {stem + e for e in (("ού", "ό", "έ") if accent else ("ου", "ο", "ε"))}
        elif word.endswith(("ης", "ής", "ας", "άς")):
            forms.add(word[:-1])
        elif word[-1] in "αάηή":
            forms.add(word + "ς")
        import unicodedata

        bare = {unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", f) if not unicodedata.combining(c))) for f in forms}
        out |= forms | bare
    drop = {fold_text(w) for w in non_names}
    return {f for f in out if fold_text(f) not in drop}


def contact_pattern(contacts: Sequence[str]) -> str | None:
    forms = {v for c in contacts for v in name_variants(c)}
    return rf"(?iU)\b(?:{alternation(sorted(forms))})\b" if forms else None


def full_name_pattern(non_names: Sequence[str] = V.NON_NAMES) -> str:
    """Two capitalised words, the first of which is no listed word."""
    return rf"(?U)\b(?!(?:{alternation(non_names)})\b){FULL_NAME[len('(?U)') + 2:]}\s+{FULL_NAME[len('(?U)') + 2:]}\b"


def sanitise(text: Column, contacts: Sequence[str] = (), placeholders: dict[str, str] | None = None) -> Column:
    """All masks in order: IBAN, AMKA, AFM, identity card, phone, e-mail, contacts, full names."""
    p = PLACEHOLDERS | (placeholders or {})
    out = reduce(lambda t, c: mask(t, c, p[c]), ("iban", "amka", "afm", "id_card", "phone", "email"), text)
    if pattern := contact_pattern(contacts):
        out = F.regexp_replace(out, pattern, p["name"])
    return F.regexp_replace(out, full_name_pattern(), p["name"])


def sanitise_records(rows: DataFrame, fields: Sequence[str], contacts: Sequence[str] = ()) -> DataFrame:
    """Masked fields and ``changed``; fields that are not strings stay."""
    strings = [f.name for f in rows.schema if f.name in fields and f.dataType.simpleString() == "string"]
    masked = rows.withColumns({f"_new_{f}": sanitise(F.col(f), contacts) for f in strings})
    changed = reduce(lambda a, b: a | b, (~F.col(f"_new_{f}").eqNullSafe(F.col(f)) for f in strings), F.lit(False))
    masked = masked.withColumn("changed", changed)
    return masked.select(*(F.col(f"_new_{c}").alias(c) if c in strings else F.col(c) for c in rows.columns), "changed")


def report(rows: DataFrame, fields: Sequence[str], categories: Sequence[str] = ("iban", "amka", "afm", "id_card", "phone", "email")) -> DataFrame:
    """category, n over all fields, most frequent first."""
    counts = [F.sum(sum((F.coalesce(count(F.col(f), c), F.lit(0)) for f in fields), F.lit(0))).alias(c) for c in categories]
    return rows.agg(*counts).unpivot([], list(categories), "category", "n").orderBy(F.desc("n"), "category")


def residual(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Columns are scanned, not a serialised dump, so escapes cannot hide a match."""
    return report(rows, fields).filter("n > 0")


def gate(found: DataFrame, what: str = "personal data remains") -> None:
    """Raise unless ``found`` is empty."""
    if not found.isEmpty():
        raise ValueError(f"{what}: {found.limit(10).collect()}")


#: Stems, endings and exact names of the audit of finished sets, fewer than the masks know.
AUDIT_STEMS = tuple(
    "παναγιωτ δημητρ γιανν ιωανν κωνσταντιν κωστ αποστολ αθανασ βασιλ νικολ "
    "χρηστ μιχαλ αντων στελ πετρ θεοδωρ σπυρ ανδρε αλεξανδρ μανωλ ηλια "
    "λευτερ σωτηρ χαραλαμπ λαμπρ μανθ θωμα στεφαν γρηγορ παυλ μαρκ "
    "μαρι ελεν κατεριν σοφι γιωτ δημητρα βασιλικ αναστασ αννα χριστιν "
    "δεσποιν ευαγγελ αγγελικ ειρην φωτειν χρυσ σταυρ παρασκευ".split()
)
AUDIT_ENDINGS = ("ιτσα", "ουλα", "ακης", "ακη", "ος", "ας", "ης", "ες", "ου", "ων", "α", "η", "ο", "ε", "ς", "")
AUDIT_EXACT = ("νικος", "νικο", "ευα", "τασος", "φωτης", "ζωη")


def audit_names(rows: DataFrame, fields: Sequence[str] = ("instruction_clean", "response_clean", "conversation_with"), own: Sequence[str] = ()) -> DataFrame:
    """word, n: given names that a finished set still holds, most frequent first; for ``gate``."""
    all_ = F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields))
    words = rows.select(F.explode(F.flatten(F.transform(all_, lambda t: F.regexp_extract_all(fold(t), F.lit(r"(?U)\w+"), 0)))).alias("word"))
    hit = given_name(F.col("word"), stems=AUDIT_STEMS, endings=AUDIT_ENDINGS, exact=AUDIT_EXACT, keep=V.CALENDAR_AND_PLACES, own=own)
    return words.filter(hit).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


def affected(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("records"), F.count_if(hit).alias("affected"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("share"))


def given_name(token: Column, stems=V.GIVEN_NAME_STEMS, endings=V.NAME_ENDINGS, exact=V.EXACT_GIVEN_NAMES,
               keep=(*V.CALENDAR_AND_PLACES, *V.NAME_LIKE_WORDS), own: Sequence[str] = ()) -> Column:
    """Whether a token is a stem with an ending, or an exact name, and no listed word or own name."""
    folded = fold(token)
    pattern = f"^(?:(?:{alternation([fold_text(s) for s in stems])})(?:{alternation([fold_text(e) for e in endings if e])})?|{alternation([fold_text(x) for x in exact])})\\z"
    found = folded.rlike(pattern) & ~folded.isin(*{fold_text(k) for k in keep})
    for name in own:
        found = found & ~F.startswith(folded, F.lit(fold_text(name)))
    return found


def redact_given_names(text: Column, placeholder: str = "[NAME]", **lists) -> Column:
    return mask_tokens(text, r"(?U)\w+", r"\W+", lambda t: given_name(t, **lists), placeholder)


def surname(token: Column, gazetteer: Sequence[str] = (), own: Sequence[str] = (), suffixes=V.SURNAME_SUFFIXES,
            adjectival=V.ADJECTIVAL_ENDINGS, ordinary=V.NOT_SURNAMES, places=V.PLACE_NAMES) -> Column:
    """Short and own names no, gazetteer prefix yes, listed words and adjectives no, typical ending yes."""
    ends = lambda f, xs: f.rlike(f"(?:{alternation([fold_text(x) for x in xs])})\\z") if xs else F.lit(False)
    starts = lambda f: f.rlike(f"^(?:{alternation([fold_text(x) for x in gazetteer])})") if gazetteer else F.lit(False)
    drop = {fold_text(x) for x in (*ordinary, *places)}

    def judge(f: Column) -> Column:
        return (
            F.when(F.length(f) < 5, False).when(f.isin(*{fold_text(o) for o in own}) if own else F.lit(False), False).when(starts(f), True)
            .when(f.isin(*drop) if drop else F.lit(False), False).when(ends(f, adjectival), False).otherwise(ends(f, suffixes))
        )

    # Folding makes two letters of one at most, so shorter tokens need none.
    return F.when(F.length(token) < 3, False).otherwise(let(fold(token), judge))


def redact_surnames(text: Column, placeholder: str = "[SURNAME]", **lists) -> Column:
    return mask_tokens(text, r"(?U)[^\W\d_]+", r"[\W\d_]+", lambda t: surname(t, **lists), placeholder)


def surname_counts(rows: DataFrame, fields: Sequence[str], **lists) -> DataFrame:
    """word, n of surnames over the fields."""
    all_ = F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields))
    hits = lambda t: F.filter(F.regexp_extract_all(t, F.lit(r"(?U)[^\W\d_]+"), 0), lambda w: surname(w, **lists))
    words = rows.select(F.explode(F.flatten(F.transform(all_, hits))).alias("token"))
    return words.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"))


def clean_verified(rows: DataFrame, fields: Sequence[str], path: str, **lists) -> None:
    """Redact, write aside, scan the files written, and move them to their place only if nothing is left."""
    cleaned = rows.withColumns({f: redact_surnames(F.col(f), **lists) for f in fields})
    publish.publish(cleaned, path, lambda files: gate(surname_counts(files, fields, **lists), "surnames remain"), "json")


def bare(text: Column) -> Column:
    return strip_accents(text)
