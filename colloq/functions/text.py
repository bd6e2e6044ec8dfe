"""Column functions for text: folding, tokens, sentences, n-grams, markers, trimming.

All are built from Catalyst expressions. Regular expressions carry ``(?U)`` so that ``\\w`` and
``\\b`` know all letters; null in gives null out unless stated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decompositions(keep_case: bool) -> tuple[str, str]:
    """Precomposed letters of the Latin and Greek blocks and their bases."""
    left, right = [], []
    for point in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1F00, 0x2000)):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and (keep_case or c == c.lower()):
            left.append(c)
            right.append(base)
    return "".join(left), "".join(right)


_FOLD_FROM, _FOLD_TO = _decompositions(keep_case=False)
_STRIP_FROM, _STRIP_TO = _decompositions(keep_case=True)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row.

    An expression used inside a lambda is evaluated again for every element; bound like this it
    is a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _all_ascii(text: Column) -> Column:
    """Whether a text has nothing to strip: as many bytes as letters."""
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Lower case without diacritics; final sigma is sigma, sharp s is ss."""

    def full(t: Column) -> Column:
        lowered = F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))
        return F.regexp_replace(F.translate(lowered, _FOLD_FROM + "ς", _FOLD_TO + "σ"), r"\p{M}+", "")

    return let(text, lambda t: F.when(_all_ascii(t), F.lower(t)).otherwise(full(t)))


def fold_text(text: str) -> str:
    """``fold`` for constants."""
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def strip_accents(text: Column) -> Column:
    """Without diacritics, case and final sigma kept."""
    full = lambda t: F.regexp_replace(F.translate(t, _STRIP_FROM, _STRIP_TO), r"\p{M}+", "")
    return let(text, lambda t: F.when(_all_ascii(t), t).otherwise(full(t)))


def search_tokens(text: Column) -> Column:
    """Runs of Latin letters, digits and Greek letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9Ͱ-Ͽἀ-῿]+"), 0)


def words(text: Column) -> Column:
    """Runs of word characters of the lower-cased text, accents kept."""
    return F.regexp_extract_all(F.translate(F.lower(text), "ς", "σ"), F.lit(r"(?U)\w+"), 0)


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)[^\W\d_]+"), 0)


def space_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Stripped, non-empty parts between runs of . ! ; ? …"""
    return F.filter(F.transform(F.split(text, "[.!;?…]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences_with_ends(text: Column) -> Column:
    """Sentences that keep their terminator; line breaks also end one."""
    return F.filter(F.split(text, r"(?<=[.!;?·])\s+|\n+"), lambda s: F.trim(s) != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined windows of n tokens; empty if there are fewer."""
    if n < 1:
        raise ValueError("n must be positive")

    def windows(t: Column) -> Column:
        heads = F.slice(t, 1, F.greatest(F.size(t) - (n - 1), F.lit(0)))
        return F.transform(heads, lambda _, i: F.array_join(F.slice(t, i + 1, n), " "))

    return let(tokens, windows)


def _case_variants() -> tuple[str, str]:
    """Small letters with another small letter's capital (final sigma, long s), and those others."""
    found = [(c, c.upper().lower()) for c in map(chr, range(0x80, 0x1FFFF)) if not 0xD800 <= ord(c) < 0xE000 and c == c.lower()]
    # One letter's final sigma is by its place; here it is sigma.
    found = [(c, o.replace("ς", "σ")) for c, o in found if len(o) == 1 and o.replace("ς", "σ") != c]
    return "".join(c for c, _ in found), "".join(o for _, o in found)


_CASE_FROM, _CASE_TO = _case_variants()


def caseless(text: Column) -> Column:
    """One form of all letters that differ in case alone."""
    return F.translate(F.lower(text), _CASE_FROM, _CASE_TO)


def needed(pattern: str) -> set[str] | None:
    """Literals, lower-cased, of which every match of a regular expression holds one; none if that is not plain to see."""
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return None
    plain = lambda s: s.lower().translate(str.maketrans(_CASE_FROM, _CASE_TO))

    def of(items) -> set[str] | None:
        best, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is re._constants.LITERAL:
                run += chr(arg)
                continue
            if run:
                best.append({plain(run)})
                run = ""
            if op is re._constants.SUBPATTERN:
                best.append(of(arg[3]))
            elif op is re._constants.BRANCH:
                every = [of(x) for x in arg[1]]
                best.append(None if None in every else set().union(*every))
            elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and arg[0]:
                best.append(of(arg[2]))
        found = [b for b in best if b]
        return max(found, key=lambda b: (min(map(len, b)), -len(b)), default=None)

    return of(tree)


def may_hold(plain: Column, pattern: str) -> Column:
    """Whether a text in its ``caseless`` form may hold a match of the pattern, letters of either case; never false where it does."""
    literals = needed(pattern)
    if literals is None:
        return F.lit(True)
    found = F.lit(False)
    for literal in sorted(literals):
        found = found | F.contains(plain, F.lit(literal))
    return found


def contains_any(folded: Column, markers: Sequence[str]) -> Column:
    """Whether a folded text holds any of the markers (folded here)."""
    found = F.lit(False)
    for marker in sorted({fold_text(m) for m in markers}):
        found = found | F.contains(folded, F.lit(marker))
    return found


def count_chars(text: Column, ranges: str) -> Column:
    """Characters of a regular-expression class body; whole runs are matched, far fewer than characters."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{ranges}]+", ""))


GREEK = "Ͱ-Ͽἀ-῿"
LATIN = "A-Za-z"


def script_tag(text: Column, ranges: str, yes: str, no: str) -> Column:
    """``yes`` if any character of the class occurs."""
    return F.when(text.rlike(f"[{ranges}]"), F.lit(yes)).otherwise(F.lit(no))


#: Words in -ω that are no verbs, and first-person pronouns.
OMEGA_EXCEPTIONS = ("κατω", "πανω", "εδω", "πισω", "εξω", "μεσω", "ηχω")
FIRST_PERSON_PRONOUNS = ("εγω", "μου", "μενα", "μας", "εμεις")


def first_person(folded: Column) -> Column:
    """First-person singular by inflection (-ω, -μαι) or pronoun; a text without ω and μ, which all have, is not split."""
    tokens = F.regexp_extract_all(folded, F.lit(r"(?U)\w+"), 0)
    verb = F.exists(
        tokens,
        lambda w: ((F.endswith(w, F.lit("ω")) & (F.length(w) >= 3)) | (F.endswith(w, F.lit("μαι")) & (F.length(w) >= 5)))
        & ~w.isin(*OMEGA_EXCEPTIONS),
    )
    found = verb | F.exists(tokens, lambda w: w.isin(*FIRST_PERSON_PRONOUNS))
    return F.when(F.contains(folded, F.lit("ω")) | F.contains(folded, F.lit("μ")), found).when(folded.isNotNull(), F.lit(False))


#: Capitalised words that start sentences and name nothing.
SENTENCE_STARTERS = (
    "ναι", "οχι", "καλα", "ενταξει", "ωραια", "τελεια", "βεβαια", "επισης", "ομως", "αλλα", "τωρα", "μετα", "αυριο", "σημερα",
    "χθες", "παντως", "μαλλον", "ισως", "σιγουρα", "θα", "και", "αν", "οταν", "γιατι", "ετσι", "λοιπον", "απλα", "μονο",
)


def checkable_claims(text: Column, starters: Sequence[str] = SENTENCE_STARTERS) -> Column:
    """Folded numbers and capitalised words (three letters or more) that can be checked."""
    # The first character is looked at before the word boundary, which takes far longer.
    numbers = F.regexp_extract_all(text, F.lit(r"(?U)(?=\d)\b\d[\d.,:/]*\b"), 0)
    names = F.regexp_extract_all(text, F.lit(r"(?U)(?=[Α-ΩΆΈΉΊΌΎΏA-Z])\b[Α-ΩΆΈΉΊΌΎΏA-Z][α-ωάέήίόύώϊϋΐΰa-z]{2,}\b"), 0)
    named = F.filter(F.transform(names, fold), lambda w: ~w.isin(*(fold_text(s) for s in starters)))
    return F.array_distinct(F.concat(F.transform(numbers, fold), named))


def trim_to_words(text: Column, budget: Column | int) -> Column:
    """At most ``budget`` words, ending at a sentence where one ends in the second half."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    tokens = space_words(text)
    cut = F.array_join(F.slice(tokens, 1, F.greatest(budget, F.lit(0))), " ")
    out = F.concat(cut, F.lit("…"))
    for mark in ("? ", "! ", "· ", ". "):
        head = F.substring_index(cut, mark, -1)
        head = F.substring(cut, F.lit(1), F.length(cut) - F.length(head) - len(mark))
        fits = F.contains(cut, F.lit(mark)) & (F.size(space_words(head)) >= F.floor(budget / 2))
        out = F.when(fits, F.concat(head, F.lit(mark.strip()))).otherwise(out)
    out = F.when(cut.rlike("[.·!;?]$"), cut).otherwise(out)
    return F.when(F.size(tokens) <= budget, text).otherwise(out)


def capitalise_sentences(text: Column) -> Column:
    """First letter, and letters after . ! ? and white space, in upper case."""
    parts = F.split(text, r"(?U)(?<=[.!?]\s{1,9})(?=\w)")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), F.substr(p, F.lit(2)))), "")


def first_sentences(text: Column, most: int = 3) -> Column:
    """struct(text, original_length, truncated): the first sentences, ended with a full stop."""
    parts = F.filter(F.split(text, "[.!;]+"), lambda s: F.trim(s) != "")
    kept = F.array_join(F.transform(F.slice(parts, 1, most), lambda s: F.trim(s)), ". ")
    short = F.when(kept.rlike("[.!]$"), kept).otherwise(F.concat(kept, F.lit(".")))
    long = F.size(parts) > most
    return F.struct(F.when(long, short).otherwise(text).alias("text"), F.size(parts).alias("original_length"), long.alias("truncated"))


def strip_quoted(text: Column) -> Column:
    """Lines of a mail reply before the first quoted line or signature."""
    mark = (
        r"(?sm)^(?:\s*>|On [^\n]{5,80} wrote:\s*$|Στις [^\n]{5,80} έγραψε:?\s*$|-{2,}\s*(?:Original Message|Αρχικό μήνυμα)|\s*--\s*$).*"
    )
    return F.regexp_replace(F.regexp_replace(text, mark, ""), r"^\s+|\s+$", "")


def clean_name(text: Column, most: int = 24) -> Column:
    """First letter run, shortened, capitalised; empty if there is none."""
    run = F.regexp_extract(text, r"(?U)[^\W\d_]+", 0)
    short = F.substring(run, 1, most)
    return F.concat(F.upper(F.substring(short, 1, 1)), F.lower(F.substr(short, F.lit(2))))


def mentions(name: str, folded: Column) -> Column:
    """Whole-name mention; letters and digits beside it do not count."""
    return folded.rlike(rf"(?<![a-z0-9]){_escaped(fold_text(name))}(?![a-z0-9])")


def negated_before(text: Column, pattern: str, reach: int = 60) -> Column:
    """Whether a negation stands before the first match of ``pattern`` in its sentence."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - reach, F.lit(1))
    window = F.substring(text, start, at - start)
    return (at > 0) & F.substring_index(F.translate(window, "!?;·", "...."), ".", -1).rlike(r"(?U)\b(?:δεν|δε|όχι|οχι|χωρίς|χωρις)\b")


def clipped_lines(*parts: Column) -> Column:
    """Parts on lines of their own; null and empty ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n")


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|-" else c for c in text)


def alternation(texts: Sequence[str]) -> str:
    """A regular expression for any of the texts, longest first."""
    return "|".join(_escaped(t) for t in sorted(set(texts), key=lambda t: (-len(t), t)))
