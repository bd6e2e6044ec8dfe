"""Surname candidates by capture span."""

import re

import pytest

from colloq import fixed_values as V
from colloq.functions.text import fold_text
from colloq.operators import mining

from pyspark.sql import functions as F


def mined(spark, texts, frames=V.NAME_FRAMES, **more):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return [(r.word, r.frames, r.total, round(r.ratio, 4)) for r in mining.mine_surnames(rows, "t", frames, **more).collect()]


def test_a_span_counts_once(spark):
    """One place that two frames capture is one; two places that are both a frame's first match are two."""
    assert mined(spark, ["a foo zzzz b foo qqqq bar qqqq"], (r"foo (\w+)", r"b foo (\w+)"), least=1) == [("zzzz", 1, 1, 1.0), ("qqqq", 1, 2, 0.5)]
    assert mined(spark, ["foo qqqq . bar qqqq"], (r"foo (\w+)", r"bar (\w+)")) == [("qqqq", 2, 2, 1.0)]


def plain(texts, frames):
    """Spans by the standard library's matcher."""
    frames_, total = {}, {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t or ""):
            total[fold_text(w)] = total.get(fold_text(w), 0) + 1
        spans = {m.span(1): m.group(1) for f in frames for m in re.finditer(f, t or "", re.I)}
        for w in spans.values():
            frames_[fold_text(w)] = frames_.get(fold_text(w), 0) + 1
    return {w: (n, total[w]) for w, n in frames_.items()}


def test_the_seven_frames(spark):
    texts = [
        "πες στον Βλάχο οτι ο Βλάχος ειπε ναι, με τον Βλάχο μιλησα", "Ο Ζαρίφος λέει; ο ζαριφος λεει και ο κ. Ζαριφος", "κυριε Ζαρίφο, στειλε του Ζαρίφου",
        "για τον εαυτό του, στην αρχή της εβδομάδας, στην αρχη της", "η κινητη τηλεφωνια", None, "", "γραψε ζαριφος \ufdd0 στον ζαριφος στον\nζαριφος",
        "ρωτα τον Ζαρίφο και πες ζαριφο ειπε", "του παπαδοπουλου, του παπαδοπουλου", "στην Βαγγελιστρα στην Βαγγελιστρα",
    ]
    found = {w: (f, n) for w, f, n, _ in mined(spark, texts, least=1)}
    want = plain([t for t in texts if t], V.NAME_FRAMES)
    noise = {fold_text(x) for x in V.FRAME_NOISE}
    assert found == {w: v for w, v in want.items() if w not in noise and "παπαδοπ" not in w and w in found}
    assert found["ζαριφοσ"] == want["ζαριφοσ"] and found["βλαχο"] == (2, 2) and not set(found) & noise
    assert "παπαδοπουλου" not in found and "ινητη" not in found  # known by the surname rules; not after a bare kappa
    assert all(r <= 1 for *_, r in mined(spark, texts, least=1))


def test_own_names_and_gazetteer_prefixes(spark):
    texts = ["foo abcd foo abce foo bcde foo xabc foo mine"] * 2
    stems = spark.createDataFrame([("ΑΒΓ",), ("Abc",), ("",), (None,), ("mineral",), ("bcde",)], "stem string")
    assert [w for w, *_ in mined(spark, texts, (r"foo (\w+)",))] == ["abcd", "abce", "bcde", "mine", "xabc"]
    assert [w for w, *_ in mined(spark, texts, (r"foo (\w+)",), gazetteer=stems, own=("Mine",), noise=())] == ["xabc"]
    assert "Cartesian" not in (plan := mining.without_prefix(stems.selectExpr("stem as word"), stems)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


@pytest.mark.parametrize("pattern", ["no group", r"a(?:b(c)d)", r"\(x\)", "[(]x"])
def test_patterns_without_a_plain_group(pattern):
    with pytest.raises(ValueError):
        mining.around_group(pattern)


def test_places(spark):
    text = "漢字 é of the name, of 😀 the time and the time"
    frames = (r"\b(?:of|the)\s+([^\W\d_]{4,})", r"[\]\)(]?of the ([a-z]+)", r"(\w+) and\b")
    want = sorted({(m.start(1), m.group(1)) for f in frames for m in re.finditer(f, text)})
    rows = spark.createDataFrame([(1, text)], "id long, t string")
    assert sorted((r.start, r.word) for r in mining.with_places(rows, "t", frames, ["id"]).collect()) == want
    assert rows.select(F.size(mining.captures(F.lit(None).cast("string"), "(x)"))).first()[0] in (None, -1)
    assert mining.ranked_report(mining.mine_surnames(rows, "t", frames, least=1)).count() > 0


def test_claims_of_an_unread_calendar(spark):
    from colloq.operators import claims

    rows = [
        ("Θα πάω στο πάρτυ.", "schedule", False, "τι κάνεις;"), ("Θα πάω στο πάρτυ.", "schedule", None, "Τι ώρα θα ξεκινήσουμε;"), ("Θα πάω στο πάρτυ;", "schedule", False, "τι"),
        ("Θα πάω στο πάρτυ.", "schedule", True, "τι"), ("Θα πάω στο πάρτυ.", "casual", False, "τι"), (None, "schedule", False, None), ("Καλά. Ναι;\nθα παω", "schedule", False, None),
    ]
    frame = spark.createDataFrame(rows, "reply string, intent string, ok boolean, message string")
    c = claims.without_schedule_claims(F.col("reply"), F.col("intent"), F.col("ok"), F.col("message"), r"\bθα\s+παω\b")
    found = [(r.c.text, r.c.replaced) for r in frame.select(c.alias("c")).collect()]
    assert [x for _, x in found] == [True, True, False, False, False, False, True]
    assert [t for t, _ in found] == [V.SCHEDULE_REFUSAL, V.SCHEDULE_ASK_WHICH, rows[2][0], rows[3][0], rows[4][0], None, V.SCHEDULE_REFUSAL]


def test_texts_are_not_read_again_for_gazetteers(spark, tmp_path):
    """Counts are kept in a table: what comes after reads no text (F8)."""
    path = str(tmp_path / "texts")
    spark.createDataFrame([("see anton and anton and Berta and berta",), (None,)], "text string").write.parquet(path)
    stems = spark.createDataFrame([("bert",)], "stem string")
    found = mining.mine_surnames(spark.read.parquet(path), "text", (r"([^\W\d_]{4,}) and",), noise=(), gazetteer=stems)
    assert [tuple(r) for r in found.select("word", "frames", "total").collect()] == [("anton", 2, 2)]
    assert not any(path in f for f in found.inputFiles())
