"""Style, diversity, grounding, reliability, latency and scaling metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import set_join

#: Phrases of an assistant, and admissions of not knowing.
ASSISTANT_TELLS = (
    "πώς μπορώ να σας βοηθήσω", "πως μπορω να σας βοηθησω", "είμαι εδώ για να", "ειμαι εδω για να",
    "ως τεχνητή νοημοσύνη", "ως τεχνητη νοημοσυνη", "ως ai", "as an ai", "i'm an ai", "language model",
    "δεν έχω τη δυνατότητα", "δεν εχω τη δυνατοτητα",
)
REFUSALS = (
    "δεν ξέρω", "δεν ξερω", "δεν θυμάμαι", "δεν θυμαμαι", "δεν είμαι σίγουρος", "δεν ειμαι σιγουρος",
    "δεν έχω ιδέα", "δεν εχω ιδεα", "i don't know", "i do not know", "not sure",
)
#: Weights and scales of the style distance.
STYLE_WEIGHTS = {
    "mean_words_per_response": 1.0, "mean_words_per_sentence": 1.0, "mean_sentences_per_response": 1.0,
    "type_token_ratio": 1.0, "greek_ratio": 1.5, "question_rate": 0.5, "exclamation_rate": 0.5,
    "first_person_rate": 2.0, "assistant_tell_rate": 3.0,
}
STYLE_SCALES = {"mean_words_per_response": 40.0, "mean_words_per_sentence": 20.0, "mean_sentences_per_response": 5.0}


def rate(condition: Column) -> Column:
    """Mean of a condition; 0 for no rows, null counts as false."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def style_profile(rows: DataFrame, keys: Sequence[str] = (), text: str = "text", ranges: str = T.GREEK, tells: Sequence[str] = ASSISTANT_TELLS) -> DataFrame:
    """Nine style measures of the non-blank texts of each group, and n_samples.

    The distinct-word count of the pooled vocabulary is its own aggregation over (group, word), so
    no group's words meet in one row.
    """
    usable = rows.filter(F.trim(text) != "")
    folded, tokens = T.fold(F.col(text)), T.words(F.col(text))
    each = usable.select(
        *keys, F.size(tokens).alias("w"), F.greatest(F.size(T.sentences(F.col(text))), F.lit(1)).alias("s"),
        T.count_chars(F.col(text), ranges).alias("script"), T.count_chars(F.col(text), T.LATIN).alias("latin"),
        F.col(text).rlike("[?;]").alias("question"), F.contains(text, F.lit("!")).alias("exclamation"),
        T.first_person(folded).alias("first"), T.contains_any(folded, tells).alias("tell"),
    )
    means = each.groupBy(*keys).agg(
        F.avg("w").alias("mean_words_per_response"), F.avg(F.col("w") / F.col("s")).alias("mean_words_per_sentence"),
        F.avg("s").alias("mean_sentences_per_response"), F.sum("w").alias("_words"),
        F.coalesce(F.try_divide(F.sum("script"), F.sum(F.col("script") + F.col("latin"))), F.lit(0.0)).alias("greek_ratio"),
        rate(F.col("question")).alias("question_rate"), rate(F.col("exclamation")).alias("exclamation_rate"),
        rate(F.col("first")).alias("first_person_rate"), rate(F.col("tell")).alias("assistant_tell_rate"), F.count("*").alias("n_samples"),
    )
    vocabulary = usable.select(*keys, F.explode(tokens).alias("word")).distinct().groupBy(*keys).agg(F.count("*").alias("_types"))
    if keys:
        types = vocabulary.select("_types", *(F.col(k).alias(f"_{k}") for k in keys))
        joined = means.join(types, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left")
    else:
        joined = means.crossJoin(F.broadcast(vocabulary))
    ratio = F.coalesce(F.try_divide(F.col("_types"), F.col("_words")), F.lit(0.0))
    return joined.select(*keys, *(ratio.alias(c) if c == "type_token_ratio" else F.col(c) for c in STYLE_WEIGHTS), "n_samples")


def style_distance(a: str, b: str) -> Column:
    """Weighted mean of clipped, scaled differences of two profiles with column prefixes."""
    total = F.lit(0.0)
    for name, weight in STYLE_WEIGHTS.items():
        apart = F.abs(F.col(f"{a}.{name}") - F.col(f"{b}.{name}")) / STYLE_SCALES.get(name, 1.0)
        total = total + weight * F.least(apart, F.lit(1.0))
    return total / sum(STYLE_WEIGHTS.values())


def distinct_n(rows: DataFrame, n: int, keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Share of different n-grams among all n-grams of a group's pool."""
    grams = rows.select(*keys, F.explode(T.ngrams(T.words(F.col(text)), n)).alias("gram"))
    counted = grams.groupBy(*keys, "gram").agg(F.count("*").alias("c"))
    return counted.groupBy(*keys).agg((F.count("*") / F.sum("c")).alias(f"distinct_{n}"), F.sum("c").alias("n_grams"))


def repetition_rate(text: Column, n: int = 3) -> Column:
    """Share of a text's n-grams beyond the different ones."""
    share = lambda g: F.when(F.size(g) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g))
    return T.let(T.ngrams(T.words(text), n), share)


def _share_found(items: Column, folded: Column, found: bool, empty: float) -> Column:
    """Share of the items that the folded text holds (or lacks); ``empty`` for no items."""
    held = lambda x, inside: F.contains(inside, x) if found else ~F.contains(inside, x)
    share = lambda v, inside: F.when(F.size(v) == 0, empty).otherwise(F.size(F.filter(v, lambda x: held(x, inside))) / F.size(v))
    return T.let(folded, lambda inside: T.let(items, lambda v: share(v, inside)))


def _folded(words: Column, fold) -> Column:
    """The words, which hold no space, folded in one go."""
    return T.let(words, lambda w: F.when(F.size(w) == 0, w).otherwise(F.split(fold(F.array_join(w, " ")), " ")))


def pairwise_similarity(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """id_a, id_b, jaccard of all pairs that share a word, by a join on words.

    Pairs that share none have similarity 0 and are not produced; ``mean_similarity`` counts them. For a
    threshold ``set_join.similar_pairs`` compares far fewer.
    """
    tokens = rows.select(F.col(id_).alias("id"), F.explode(F.array_distinct(T.words(F.col(text)))).alias("word"))
    sizes = tokens.groupBy("id").agg(F.count("*").alias("n"))
    shared = tokens.alias("a").join(tokens.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id")))
    shared = shared.groupBy(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).agg(F.count("*").alias("both"))
    a, b = sizes.select(F.col("id").alias("id_a"), F.col("n").alias("n_a")), sizes.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    return shared.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def mean_similarity(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """Mean over all pairs of texts with a word, pairs without a shared word included."""
    return set_join.mean_similarity(rows, T.words(F.col(text)))


def reliability(rows: DataFrame, keys: Sequence[str] = (), text: str = "text", refusals: Sequence[str] = REFUSALS, tells: Sequence[str] = ASSISTANT_TELLS) -> DataFrame:
    """Shares of refusals, assistant phrases and blank responses."""
    folded = T.fold(F.col(text))
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return rows.groupBy(*keys).agg(
        rate(T.contains_any(folded, refusals)).alias("refusal_rate"), rate(T.contains_any(folded, tells)).alias("drift_rate"),
        rate(blank).alias("empty_rate"), F.count("*").alias("n"))


def latency(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, interpolated median, and p95 as the smallest value with 95 % at or below it."""
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean_s"), F.median(value).alias("median_s"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95_s"), F.count(value).alias("n"))


def grounding_score(response: Column, context: Column, least: int = 4, words=T.words, fold=T.fold) -> Column:
    """Share of the response's longer words that occur in the context; 1 if it has none."""
    long = F.array_distinct(_folded(F.array_distinct(F.filter(words(response), lambda w: F.length(w) >= least)), fold))
    return _share_found(long, fold(F.coalesce(context, F.lit(""))), True, 1.0)


def unsupported_specifics(response: Column, context: Column, starters: Sequence[str] = T.SENTENCE_STARTERS) -> Column:
    """Share of the response's checkable claims that the context lacks; 0 if it makes none."""
    claims = T.checkable_claims(response, starters)
    return _share_found(claims, T.fold(F.coalesce(context, F.lit(""))), False, 0.0)


def verbatim_overlap(response: Column, context: Column, n: int = 5, words=T.words, fold=T.fold) -> Column:
    """Share of the response's n-grams copied from the context; 0 below n words.

    A text is folded as a whole, and an n-gram is put together only where the context has its inner words: those
    that both have are found once for each row, by a hash.
    """

    def share(w: Column, inside: Column, both: Column) -> Column:
        def copied(i: Column) -> Column:
            gram = F.contains(inside, F.array_join(F.slice(w, i + 1, n), " "))
            for k in range(min(n - 2, 3), 0, -1):
                gram = F.array_contains(both, F.get(w, i + k)) & gram
            return gram

        grams = F.size(w) - (n - 1)
        return F.when(grams < 1, 0.0).when(grams >= 1, F.size(F.filter(F.sequence(F.lit(0), F.greatest(grams, F.lit(1)) - 1), copied)) / grams)

    inside = fold(F.array_join(words(F.coalesce(context, F.lit(""))), " "))
    return T.let(inside, lambda c: T.let(_folded(words(response), fold), lambda w: T.let(F.array_intersect(w, F.split(c, " ")), lambda both: share(w, c, both))))


def accuracy(rows: DataFrame) -> DataFrame:
    """Shares and means over rows with unsupported, verbatim and grounding columns."""
    return rows.agg(
        rate(F.col("unsupported") > 0).alias("unsupported_rate"), rate(F.col("verbatim") > 0.3).alias("verbatim_rate"),
        rate(F.col("grounding") < 0.5).alias("legacy_ungrounded"), F.avg("unsupported").alias("mean_unsupported"),
        F.avg("verbatim").alias("mean_verbatim"), F.avg("grounding").alias("mean_grounding"), F.count("*").alias("n"))


def groundable(rows: DataFrame, context: str = "context", reply: str = "reply") -> DataFrame:
    return rows.filter((F.coalesce(F.length(context), F.lit(0)) > 0) & (F.trim(reply) != ""))


def corpus_stats(rows: DataFrame, response: str = "response", ranges: str = T.GREEK) -> DataFrame:
    return rows.agg(
        F.count("*").alias("pairs"), F.avg(F.length(response)).alias("avg_response_chars"),
        F.max(F.length(response)).alias("max_response_chars"), rate(F.col(response).rlike(f"[{ranges}]")).alias("script_ratio"))


def tally(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``column`` values per ``row`` value, one column each."""
    return rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))


def instability(rows: DataFrame, keys: Sequence[str], success: Column) -> DataFrame:
    """Per cell with more than one run: share of successes, whether it is mixed, population deviation."""
    cells = rows.groupBy(*keys).agg(F.avg(success.cast("double")).alias("p"), F.stddev_pop(success.cast("double")).alias("spread"), F.count("*").alias("runs"))
    return cells.filter("runs > 1").withColumn("mixed", (F.col("p") > 0) & (F.col("p") < 1))


def scaling(timings: DataFrame) -> DataFrame:
    """Speed-up, efficiency and overhead against the fewest workers (rows: num_workers, seconds)."""
    base = timings.agg(F.min(F.struct("num_workers", "seconds")).alias("b"))
    rows = timings.crossJoin(F.broadcast(base))
    more = F.col("num_workers") / F.col("b.num_workers")
    speed = F.col("b.seconds") / F.col("seconds")
    return rows.select("num_workers", "seconds", speed.alias("speedup"), (speed / more).alias("efficiency"),
                       F.greatest(F.lit(0.0), F.col("seconds") - F.col("b.seconds") / more).alias("overhead_s"))


def ablation(rows: DataFrame) -> DataFrame:
    """Per model: coverage, non-answers, latency and words of non-blank replies."""
    n_words = F.size(T.space_words(F.col("reply")))
    return rows.groupBy("model").agg(
        F.avg("coverage").alias("mean_coverage"), F.count_if(F.col("coverage") == 0).alias("non_answers"),
        F.avg("latency").alias("mean_latency"), F.avg(F.when(F.trim("reply") != "", n_words)).alias("mean_words"))


def term_coverage(text: Column, terms: Sequence[str], fold=T.fold) -> Column:
    """Share of the expected terms that occur, both folded; a null text has none."""
    folded = fold(F.coalesce(text, F.lit("")))
    return sum((F.contains(folded, fold(F.lit(t))).cast("int") for t in terms), F.lit(0)) / max(len(terms), 1)


def side_by_side(rows: DataFrame, key: str, pivot: str, value: str, columns: Sequence[str]) -> DataFrame:
    """One row per key, one column per pivot value: the value's mean."""
    return rows.groupBy(key).pivot(pivot, list(columns)).agg(F.avg(value))


def markdown(rows: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """One row with a Markdown table; for report-sized inputs."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), line.alias("_l")))), lambda r: r["_l"]), "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("markdown"))


def zip_checked(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    """Join by position; unequal sizes or positions are an error."""
    ok = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("inputs differ in length"))
    marked = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), pos, "full")
    return marked.filter(ok.isNull()).drop("_l", "_r")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of a double."""
    return F.bround(value, digits)
