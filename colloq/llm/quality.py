"""Quality rules with risk-controlled cutoffs (operator 6), DataFrame and SQL functions only.

Every whole text gets counts of words, symbols, repeated lines and words in repeated 3-word
windows. Four ratio rules then reject a document whose ratio exceeds a cutoff. The cutoffs come
from labelled holdout documents, per stratum (``lang``): for each rule the grid is tested from the
loosest cutoff on; a cutoff is certified if seeing as few rejected good documents would have
probability ``DELTA`` / (rules * strata) at most, were the rule's false rejection rate
``ALPHA`` / rules (exact binomial tail); the first that fails ends the sequence (fixed-sequence
testing needs no further correction within a rule, Bonferroni corrects over rules and strata).
So with probability 1 - DELTA no stratum loses more than ALPHA of its good documents. Of the
certified cutoffs the one with the most rejected bad documents, less ten times the rejected good
ones, is used, the loosest on ties. A rule without a certified cutoff rejects nothing there.

Defined results: a null or empty text has no words, fails the base rule and is not kept; null
lang is the stratum ``und``; null labels are ignored; repeated rows are judged alike; a document
with several labels counts once for each; a stratum without labels has no cutoffs; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ALPHA, DELTA = 0.04, 0.05
RULES = ("symbols", "bangs", "dup_lines", "long_words")
GRIDS = {
    "symbols": (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25),
    "bangs": (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "long_words": (30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0),
}

#: Places of windows that share a number with 40 bits of their hash.
_PLACES = 1 << 24
_SPACE = "[ \\\\x09-\\\\x0D]+"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the counts, base_failed and the four ratios of every whole text."""
    rows = docs.selectExpr(
        "cast(doc_id as long) as doc_id", "coalesce(lang, 'und') as stratum", "coalesce(text, '') as text",
        f"filter(split(coalesce(text, ''), '{_SPACE}'), w -> w <> '') as words",
        "filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^ \\\\x09-\\\\x0D]') as lines",
    )
    # A window is a number: 40 bits of its hash above its place. Sorted, windows of one hash stand side by
    # side; only those with a neighbour are compared by their texts. Beyond 2**24 words all are compared.
    rows = rows.selectExpr(
        "doc_id", "stratum", "words", "size(words) as n", "length(array_join(words, '')) as word_chars",
        "regexp_count(text, '[#*$%&|<>]') as n_symbols", "regexp_count(text, '[!]') as n_bangs",
        "size(lines) as n_lines", "size(lines) - size(array_distinct(lines)) as n_dup_lines",
        "if(size(words) < 3, cast(array() as array<bigint>), sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), "
        f"(w, i) -> (xxhash64(w, words[i + 1], words[i + 2]) & {-_PLACES}L) | cast(i % {_PLACES} as bigint)))) as ordered",
    )
    near = f"filter(ordered, (v, j) -> (j > 0 and ((v ^ ordered[j - 1]) & {-_PLACES}L) = 0) or (j < size(ordered) - 1 and ((v ^ ordered[j + 1]) & {-_PLACES}L) = 0))"
    rows = rows.withColumn("places", F.expr(f"if(n > {_PLACES}, sequence(0, greatest(n - 3, 0)), transform({near}, v -> cast(v & {_PLACES - 1}L as int)))"))
    rows = rows.withColumn("found", F.expr("sort_array(transform(places, i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) as t, i as i)))"))
    rows = rows.withColumn("twice", F.expr(
        "filter(found, (s, j) -> (j > 0 and found[j - 1].t = s.t) or (j < size(found) - 1 and found[j + 1].t = s.t))"))
    rows = rows.withColumn("n_repeat_words", F.expr("size(array_distinct(flatten(transform(twice, s -> array(s.i, s.i + 1, s.i + 2)))))"))
    ratio = "coalesce(try_divide(cast({} as double), cast({} as double)), 0D)"
    return rows.selectExpr(
        "doc_id", "stratum", *(f"cast({a} as long) as {b}" for a, b in (
            ("n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "n_dup_lines"), ("n_repeat_words", "n_repeat_words"))),
        "n < 50 or 100L * n_repeat_words > 50L * n as base_failed",
        ratio.format("n_symbols", "n") + " as symbols", ratio.format("n_bangs", "n") + " as bangs",
        ratio.format("n_dup_lines", "n_lines") + " as dup_lines", ratio.format("word_chars", "n") + " as long_words",
    )


def cutoffs(found: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum and a cutoff per rule (null: the rule rejects nothing), for every stratum with labels."""
    known = labels.selectExpr("cast(doc_id as long) as doc_id", "cast(quality as int) as quality").filter("quality in (0, 1)")
    seen = found.select("doc_id", "stratum", *RULES).join(known, "doc_id")
    sums, rows = ["count_if(quality = 1) as n_good"], []
    for rule in RULES:
        for k, cut in enumerate(GRIDS[rule]):
            for q, name in ((1, "good"), (0, "bad")):
                sums.append(f"count_if(quality = {q} and {rule} > {cut}D) as {rule}_{name}_{k}")
            rows.append(f"struct('{rule}' as rule, {k} as step, {cut}D as cutoff, {rule}_good_{k} as good, {rule}_bad_{k} as bad)")
    per = seen.groupBy("stratum").agg(*(F.expr(x) for x in sums))
    per = written(per, "strata")
    strata = max(1, per.count())
    grid = per.selectExpr("stratum", "n_good", f"inline(array({', '.join(rows)}))")
    # Binomial tail P(X <= good), term by term in logarithms; beyond the mean it can't be small.
    a = ALPHA / len(RULES)
    tail = f"""case when n_good = 0 or good > n_good * {a}D then 1D else
        aggregate(sequence(0L, good), struct(n_good * ln(1 - {a}D) as term, 0D as total),
            (s, i) -> struct(if(i = 0, s.term, s.term + ln(cast(n_good - i + 1 as double) / cast(i as double)) + ln({a}D / (1 - {a}D))) as term,
                s.total + exp(if(i = 0, s.term, s.term + ln(cast(n_good - i + 1 as double) / cast(i as double)) + ln({a}D / (1 - {a}D)))) as total),
            s -> s.total) end"""
    tested = grid.withColumn("fails", F.expr(f"{tail} > {DELTA}D / {len(RULES) * strata}"))
    ends = tested.groupBy("stratum", "rule").agg(
        F.coalesce(F.min(F.when(F.col("fails"), F.col("step"))), F.lit(len(max(GRIDS.values(), key=len)))).alias("fail_at"),
        F.sort_array(F.collect_list(F.struct("step", "cutoff", "good", "bad"))).alias("steps"),
    )  # at most eight steps each
    best = ends.withColumn("best", F.expr(
        "array_max(transform(filter(steps, s -> s.step < fail_at and s.bad > 0), s -> struct(s.bad - 10 * s.good as gain, -s.step as loosest, s.cutoff as cutoff)))"))
    chosen = [F.max(F.when((F.col("rule") == r) & (F.col("best.gain") > 0), F.col("best.cutoff"))).alias(f"cut_{r}") for r in RULES]
    return best.groupBy("stratum").agg(*chosen)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept."""
    found = written(features(docs), "quality")
    cuts = written(cutoffs(found, labels), "cutoffs")
    rejected = " or ".join(f"coalesce({r} > cut_{r}, false)" for r in RULES)
    # As many rows as strata: a written table, so the planner broadcasts it by its size or not at all.
    return found.join(cuts, "stratum", "left").selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        f"not base_failed and not ({rejected}) as kept",
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    sp = "[ \\x09-\\x0D]"
    a = ALPHA / len(RULES)
    grid = ", ".join(f"('{r}', {k}, {c}::double)" for r in RULES for k, c in enumerate(GRIDS[r]))
    rejected = " or ".join(f"coalesce({r} > (select c.cutoff from chosen c where c.stratum = f.stratum and c.rule = '{r}'), false)" for r in RULES)
    return f"""
with d as materialized (select row_number() over () as rid, doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as text from documents),
w as materialized (select *, list_filter(regexp_split_to_array(text, '{sp}+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) as lines from d),
p as (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as t
    from (select rid, words, unnest(range(1, greatest(len(words) - 1, 1))) as i from w)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, t) as c from p) where c > 1),
cov as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from rep) group by rid),
f as materialized (select w.doc_id, stratum, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) as n_bangs,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words
    from w left join cov using (rid)),
g as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when n_words = 0 then 0 else n_symbols::double / n_words end as symbols,
    case when n_words = 0 then 0 else n_bangs::double / n_words end as bangs,
    case when n_lines = 0 then 0 else n_dup_lines::double / n_lines end as dup_lines,
    case when n_words = 0 then 0 else word_chars::double / n_words end as long_words from f),
seen as (select stratum, quality, symbols, bangs, dup_lines, long_words from g join labels l on l.doc_id = g.doc_id where quality in (0, 1)),
strata as (select count(distinct stratum) as strata from seen),
grid(rule, step, cutoff) as (values {grid}),
tested as (select stratum, rule, step, cutoff, count(*) filter (quality = 1) as n_good,
    count(*) filter (quality = 1 and v > cutoff) as good, count(*) filter (quality = 0 and v > cutoff) as bad
    from (select stratum, quality, rule, step, cutoff,
        case rule when 'symbols' then symbols when 'bangs' then bangs when 'dup_lines' then dup_lines else long_words end as v
        from seen, grid) group by all),
judged as (select *, case when n_good = 0 or good > n_good * {a} then 1 else
    list_sum(list_transform(range(0, good + 1), lambda k: exp((case when n_good = 0 then 0 else lgamma(n_good + 1) end)
        - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln({a}) + (n_good - k) * ln(1 - {a})))) end
    > {DELTA} / ({len(RULES)} * (select strata from strata)) as fails from tested),
ends as (select *, coalesce(min(case when fails then step end) over (partition by stratum, rule), 99) as fail_at from judged),
chosen as (select stratum, rule, cutoff from ends where step < fail_at and bad - 10 * good > 0
    qualify row_number() over (partition by stratum, rule order by bad - 10 * good desc, step) = 1)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
    not base_failed and not ({rejected}) as kept from g f
"""
