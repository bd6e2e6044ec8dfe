import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloq.functions import text as T
from colloq.functions import times, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, folded", [("Γιώργος", "γιωργοσ"), ("ΓΙΏΡΓΟΣ", "γιωργοσ"), ("Straße ÉÀñ", "strasse ean"), ("ΐ ΰ", "ι υ"), (None, None)])
def test_fold(spark, text, folded):
    assert one(spark, text, T.fold) == folded
    if text:
        assert T.fold_text(text) == folded


def test_strip_accents_keeps_case_and_final_sigma(spark):
    assert one(spark, "Γιώργος Ά", T.strip_accents) == "Γιωργος Α"


def test_tokens(spark):
    assert one(spark, "Ο σκύλος, a_b ñandú 42", T.search_tokens) == ["ο", "σκύλος", "a", "b", "and", "42"]
    assert one(spark, "Α_β  γ'δ", T.words) == ["α_β", "γ", "δ"]
    assert one(spark, "ab1cd_é", T.letter_runs) == ["ab", "cd", "é"]
    assert one(spark, "  a  b\n", T.space_words) == ["a", "b"]
    assert one(spark, "Ένα. Δύο; ... !", T.sentences) == ["Ένα", "Δύο"]


@pytest.mark.parametrize("n, grams", [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])])
def test_ngrams(spark, n, grams):
    assert one(spark, "a b c", lambda x: T.ngrams(T.words(x), n)) == grams


def test_ngrams_need_a_size():
    with pytest.raises(ValueError):
        T.ngrams(F.lit(None), 0)


@pytest.mark.parametrize("text, yes", [("Το κάνω αύριο", True), ("Είμαι εδώ", True), ("εδώ κάτω", False), ("δικό μου", True), ("η νίκη", False)])
def test_first_person(spark, text, yes):
    assert one(spark, text, lambda x: T.first_person(T.fold(x))) is yes


def test_claims(spark):
    assert set(one(spark, "Ναι, ο Νίκος στις 18:30 με 2 φίλους. Αύριο θα", T.checkable_claims)) == {"νικοσ", "18:30", "2"}


@pytest.mark.parametrize(
    "text, budget, cut",
    [("ένα δύο", 5, "ένα δύο"), ("a b. c d e f", 4, "a b."), ("a b c d e", 3, "a b c…"), ("a b c. d", 3, "a b c."), ("a. b c d e f g", 6, "a. b c d e f…")],
)
def test_trim(spark, text, budget, cut):
    assert one(spark, text, lambda x: T.trim_to_words(x, budget)) == cut


def test_sentence_helpers(spark):
    assert one(spark, "ναι. όχι! ίσως", T.capitalise_sentences) == "Ναι. Όχι! Ίσως"
    assert tuple(one(spark, "α. β. γ. δ.", T.first_sentences)) == ("α. β. γ.", 4, True)
    assert tuple(one(spark, "α. β", T.first_sentences)) == ("α. β", 2, False)
    assert one(spark, "Reply\nmore\nOn Mon, X wrote:\n> old", T.strip_quoted) == "Reply\nmore"
    assert one(spark, "text\n-- \nsig", T.strip_quoted) == "text"
    assert one(spark, "  γιώργος3", T.clean_name) == "Γιώργος"


def test_negation_before_match(spark):
    assert one(spark, "δεν είναι docker", lambda x: T.negated_before(x, "docker"))
    assert not one(spark, "δεν ξέρω. είναι docker", lambda x: T.negated_before(x, "docker"))
    assert not one(spark, "nothing", lambda x: T.negated_before(x, "docker"))


def test_mentions(spark):
    assert one(spark, "with C++ code", lambda x: T.mentions("c++", T.fold(x)))
    assert not one(spark, "javascript", lambda x: T.mentions("java", T.fold(x)))


@pytest.mark.parametrize("text", ["2026-01-01 10:00:00", "25/12/2025 10:30:00", "25/12/2025, 10:30", "25/12/2025 10:30", "2026-01-01T10:00:00"])
def test_times(spark, text):
    assert one(spark, text, times.parse_time) is not None


def test_garbage_time_stays_raw(spark):
    assert one(spark, "garbage", times.parse_time) is None
    assert one(spark, "garbage", times.iso_time) == "garbage"


def test_epochs(spark):
    rows = spark.range(1).select(times.epoch_time(F.lit(1767261600)).alias("s"), times.epoch_time(F.lit(1767261600000)).alias("ms")).first()
    assert rows.s == rows.ms


@pytest.mark.parametrize("minutes, factor", [(-1, 0.2), (30, 1.5), (60, 1.5), (480, 1.0), (1440, 0.7), (2000, 0.3)])
def test_time_decay(spark, minutes, factor):
    now = dt.datetime(2026, 8, 24, 8)
    frame = spark.createDataFrame([(now, now + dt.timedelta(minutes=minutes))], "n timestamp, t timestamp")
    assert frame.select(times.time_decay(F.col("t"), F.col("n")).alias("d")).first().d == factor
    assert frame.select(times.greek_date(F.col("n")).alias("d")).first().d == "Δευτέρα 24 Αυγούστου"


def test_vectors(spark):
    f = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, z array<double>")
    r = f.select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine(F.col("a"), F.col("c")).alias("y"), vectors.cosine(F.col("a"), F.col("z")).alias("w")).first()
    assert (r.x, r.y, r.w) == (1.0, 0.0, 0.0)
    with pytest.raises(Exception, match="differ in length"):
        f.select(vectors.cosine(F.col("a"), vectors.literal([1.0]))).collect()


def test_patterns_wait_for_their_literals(spark):
    """A pattern needs one of its literals, whatever the letters' case; what has none to see is always tried (F14)."""
    from colloq import fixed_values as V
    from colloq.operators import conversation

    assert T.needed(r"\b(commit|push(ed)?)\b") == {"commit", "push"} and T.needed(r"\bτι\s+(εγινε|έγινε)\b") == {"εγινε", "έγινε"}
    assert T.needed(r"[ab]+|x") is None and T.needed(r"(x|)") is None and T.needed(r"\p{L}x") is None
    texts = ["ΠΟΤΕ μπορεις", "Ο ΛΟΓΑΡΙΑΣΜΟΣ", "iſſue", "tıme to deploy", "λεφτα", "ΤΙ ΕΓΙΝΕ με", "Straße push", "no", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for _, rules in V.INTENT_PATTERNS:
        for p, _ in rules:
            hit = F.col("t").rlike(f"(?iU){p}")
            assert frame.filter(hit & ~T.may_hold(T.caseless(F.col("t")), p)).isEmpty(), p
    plan = frame.select(conversation.intent(F.col("t")))._jdf.queryExecution().toString()
    assert plan.count("contains(") >= sum(len(T.needed(p) or ()) for _, rules in V.INTENT_PATTERNS for p, _ in rules) > 100
