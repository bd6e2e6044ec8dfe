"""Near misses of names against difflib over all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from colloq.operators import claims, near_names

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(tokens, names, ratio):
    """The best name of each token; difflib's own upper bounds only spare time."""
    best = {}
    for n in names:
        m = SequenceMatcher(None, "", n)
        for t in tokens:
            m.set_seq1(t)
            if m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio:
                best[t] = max(best.get(t, (0.0, "")), (m.ratio(), n))
    return {t: n for t, (_, n) in best.items()}


def test_all_near_tokens_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens = {r.t for r in docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\w.-]+"), 0)).alias("t")).distinct().collect()}
    rng = random.Random(1)
    names = sorted(rng.sample(sorted(t for t in tokens if len(t) >= 7), 5)) + ["apache-kafka-streams", "the"]
    found = claims.corrupted_names(docs, "text", names)
    want = brute([t for t in tokens if len(t) >= 5 and t not in names], names, 0.85)
    assert {r.token: r.name for r in found.collect()} == want and len(want) > 5


@pytest.mark.parametrize("ratio", [0.75, 0.85, 0.95])
def test_random_edits(spark, ratio):
    """Tokens made from names by edits of every kind, at the edge of the ratio too."""
    rng = random.Random(5)
    names = ["".join(rng.choice("abcé") for _ in range(n)) for n in (5, 8, 11, 17, 24, 70)]
    tokens = {"apache-kafka-streams" + "abcdefg"}
    for _ in range(250):
        t = list(rng.choice(names))
        for _ in range(rng.randint(0, 1 + len(t) // 3)):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "bb"])
        tokens.add("".join(t))
    names.append("apache-kafka-streams")
    tokens = sorted(t for t in tokens if t and t not in names)
    frames = spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(n,) for n in names], "name string")
    pairs = near_names.candidates(*frames, ratio)
    got = {r.token: r.name for r in near_names.measured(pairs, ratio).collect()}
    assert got == brute(tokens, names, ratio) and ("apache-kafka-streamsabcdefg" in got) == (ratio <= 0.85)


def test_no_product_and_edges(spark):
    a, b = spark.createDataFrame([("token",), ("",), (None,)], "token string"), spark.createDataFrame([("",), (None,)], "name string")
    assert near_names.candidates(a, b).count() == 0
    plan = near_names.candidates(a, spark.createDataFrame([("tokens",)], "name string"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        near_names.segments(10, 0.5)
    row = spark.createDataFrame([("kitten", "sitting"), ("abc", "abc"), ("漢字x", "y漢字")], "a string, b string").select(near_names.edits(F.col("a"), F.col("b")).alias("e"))
    assert [r.e for r in row.collect()] == [5, 0, 2]


def test_characters_that_the_other_lacks_are_edits(spark):
    """They never outnumber the edits, so pairs that are left out for them have too many; the letters' bits are made once a pair."""
    pairs = [("anna", "anna"), ("annab", "anna"), ("xyz", "anna"), ("nana", "anna"), ("ωμ.x", "xω"), ("a[b]", "ab"), ("", "ab")]
    f = spark.createDataFrame(pairs, "t string, n string")
    rows = f.select(near_names.strangers(F.col("t"), F.col("n")).alias("s"), near_names.edits(F.col("t"), F.col("n")).alias("e")).collect()
    assert [r.s for r in rows] == [0, 1, 7, 0, 2, 2, 2] and all(r.s <= r.e for r in rows[:-1])
