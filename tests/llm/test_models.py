"""Operators 6, 7 and 8: brute force, held-out accuracy, and defined edge cases."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from colloq.llm import common, language, quality, registry, toxicity

from llm_frames import docs_frame

SF = "/root/testdata/sf0.01"


def crc_fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out(spark):
    rows = registry.op7_language_codes(spark, SF).collect()
    langs = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and {r.doc_id for r in held} == {d for d in langs if crc_fold(d, 3) == 1}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, odd_docs, empty_docs):
    model = language.train(odd_docs)
    found = {r.doc_id: r for r in language.predict(odd_docs, model).collect()}
    for d in odd_docs.collect():
        assert (found[d.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
    assert language.train(empty_docs) is None
    assert {r.lang_pred for r in language.predict(odd_docs, None).collect()} == {"und"}
    assert language.predict(empty_docs, None).count() == 0
    kept = language.keep_identified(odd_docs, model)
    assert kept.schema == odd_docs.schema and 0 < kept.count() < odd_docs.count()


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 100])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    columns = {tuple(c * c[0]) for c in code.T}
    assert len(columns) == code.shape[1] and not any(len(set(c)) < 2 for c in columns)
    apart = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)].min()
    assert apart == 2 ** (n - 2) if n <= 6 else apart >= 9


def plain_nearest(code, weight, margin):
    loss = [sum(w * np.log1p(np.exp(-m * b)) for b, w, m in zip(c, weight, margin, strict=True)) / len(c) for c in code]
    return int(np.argmin(loss))


@pytest.mark.parametrize("n", [4, 6, 20])
def test_decoding_corrects_flipped_bits(n):
    model = language.Model.__new__(language.Model)
    model.languages, model.code = [str(i) for i in range(n)], language.codewords(n)
    bits = model.code.shape[1]
    model.bit_weight = np.ones(bits)
    for k in range(n):
        for j in range(bits):
            margin = 3.0 * model.code[k]
            margin[j] *= -1
            assert model.nearest(margin[None])[0][0] == k
    rng = np.random.default_rng(1)
    model.bit_weight = rng.random(bits)
    margins = rng.normal(size=(200, bits)) * 3
    assert model.nearest(margins)[0].tolist() == [plain_nearest(model.code, model.bit_weight, m) for m in margins]


def test_language_query_is_the_brute_force_decoding(spark, odd_docs):
    """Predictions equal a plain rerun: n-gram counts by hand, margins, nearest codeword."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30)) for a in ("abcd", "efgh", "ijkl", "mnop", "qrst") for _ in range(20)]
    docs = docs_frame(spark, texts, first=1000, langs=[f"l{i // 20}" for i in range(100)])
    model = language.train(docs.union(docs), rows=12)
    assert model.languages == [f"l{i}" for i in range(5)] and model.code.shape == (5, 15)
    both = docs.union(odd_docs)
    found = {r.doc_id: r for r in language.predict(both, model).collect()}
    for d in both.collect():
        words = [w for w in re.findall(r"[^\W\d_]+", (d.text or "").lower()) if any(c.isalpha() for c in w)]
        if not words:
            assert (found[d.doc_id].lang_pred, found[d.doc_id].score) == ("und", 0)
            continue
        c = language.counts(d.text)
        margin = np.sqrt(c / c.sum()).astype(np.float32) @ model.w + model.b
        assert found[d.doc_id].lang_pred == model.languages[plain_nearest(model.code, model.bit_weight, margin)]
    right = [found[1000 + i].lang_pred == f"l{i // 20}" for i in range(100)]
    assert all(right)


def test_every_language_is_learned(spark):
    """More languages than rows allow in full: fewer rows of each, none left out."""
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(300)]
    docs = docs_frame(spark, [(n + " ") * 30 for n in names for _ in range(3)], langs=[n for n in names for _ in range(3)])
    usable = docs.filter((language.fold_of(docs.doc_id, 3) != 1)).select("lang").distinct().count()
    assert len(language.train(docs).languages) == usable > 256


def test_no_language_to_tell_apart(spark):
    docs = docs_frame(spark, ["one text", "another text", "ein Text", None, ""], langs=["en"] * 5)
    assert {r.lang_pred for r in language.predict(docs, language.train(docs)).collect()} == {"en", "und"}


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in registry.op8_toxicity_ftrl(spark, SF).collect()}
    labels = [x for x in duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall()]
    assert all(r.held_out == (crc_fold(d, 4) == 2) for d, r in rows.items())
    right = [rows[d].predicted == t for d, t in labels if rows[d].held_out]
    assert np.mean(right) > 0.9
    assert np.mean([rows[d].score for d, t in labels if t]) > 3 * np.mean([rows[d].score for d, t in labels if not t])


def test_toxicity_edges(spark, odd_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd_docs, none)
    assert {r.predicted for r in toxicity.score(odd_docs, model).collect()} == {0}
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(100)] + [(None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd_docs, labels)
    found = toxicity.score(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(empty_docs, model).count() == 0
    assert toxicity.keep_clean(odd_docs, model).schema == odd_docs.schema


def plain_features(text):
    h = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"[^\W_]+", text.lower())]
    mixed = lambda x, tag: ((x + tag) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)
    one = {mixed(x, 1) for x in h}
    two = {mixed((a << 32) | b, 2) for a, b in zip(h, h[1:])}
    return sorted(one | two | {mixed((a << 32) | b, 3) for a, b in zip(h, h[2:])})


def plain_ftrl(rows):
    """Textbook FTRL-proximal, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for text, label in rows:
            own = [*plain_features(text), 1 << toxicity.BITS]
            w = [weight(i) for i in own]
            g = 1 / (1 + np.exp(-sum(w))) - label
            for i, x in zip(own, w, strict=True):
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / toxicity.ALPHA * x
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_toxicity_is_the_brute_force_learner(spark, odd_docs, empty_docs):
    """The whole chain, sample order included, against a plain learner; long texts keep all features."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("good", "bad", "ugly", "calm", "vile")) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    texts[3] = " ".join(f"long{i}" for i in range(9000)) + " vile1"
    docs = docs_frame(spark, texts).union(odd_docs.filter("doc_id >= 120"))
    docs = docs.union(docs.filter("doc_id in (5, 6)"))  # repeated rows count once
    marks = [(i, None, int("vile" in texts[i])) for i in range(120)]
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", common.hashed("toxicity").alias("h")).collect()}
    sample = [(hashes[i], t, np.array(plain_features(texts[i]), np.int32).tobytes(), texts[i]) for i, _, t in marks if crc_fold(i, 4) != 2]
    want = plain_ftrl([(text, label) for _, label, _, text in sorted(sample)])
    got = dict(zip(model[0].tolist(), model[1].tolist()))
    assert got and got.keys() == {i for i, w in want.items() if w}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
    for r, d in zip(toxicity.score(docs, model).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        total = sum(got.get(i, 0.0) for i in [*plain_features(d.text or ""), 1 << toxicity.BITS])
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9 and r.predicted == (r.score >= 0.3)
    assert toxicity.score(empty_docs, toxicity.train(empty_docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))).count() == 0


def plain_counts(text):
    words = [w for w in re.split("[ \x09-\x0d]+", text) if w]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("places", [1 << 24, 4, 1 << 62])
def test_quality_counts(spark, odd_docs, empty_docs, monkeypatch, places):
    """The same counts where all windows are compared (more words than places) and where hashes collide (2 bits)."""
    monkeypatch.setattr(quality, "_PLACES", places)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.judge(odd_docs, labels).collect()}
    assert len(found) == odd_docs.count()
    for d in odd_docs.collect():
        r, want = found[d.doc_id], plain_counts(d.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)
    assert quality.judge(empty_docs, labels).count() == 0


@pytest.mark.parametrize("n_good", [100, 1500])
def test_quality_cutoffs_are_certified(spark, n_good):
    rng = random.Random(2)
    words = lambda mark: " ".join(f"w{rng.randint(0, 10**6)}{mark}" for _ in range(60))
    docs = docs_frame(spark, [words("") for _ in range(n_good)] + [words("###") for _ in range(40)])
    labels = spark.createDataFrame([(i, int(i < n_good), 0) for i in range(n_good + 40)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    kept = {r.doc_id for r in rows if r.kept}
    # Too few good documents certify nothing; with enough, symbols reject the bad ones alone.
    assert len(kept) == n_good + (40 if n_good == 100 else 0)


def test_quality_many_strata(spark):
    """Every stratum has its cutoffs, however many there are."""
    texts = [" ".join(f"w{i}x{j}{mark}" for j in range(60)) for i in range(1100) for mark in ("", "###")]
    docs = docs_frame(spark, texts, langs=[f"l{i // 2}" for i in range(2200)])
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(2200)], "doc_id long, quality int, toxic int")
    assert quality.cutoffs(quality.features(docs), labels).count() == 1100
    assert quality.judge(docs, labels).filter("kept").count() == 2200  # one good document certifies nothing


def test_samples_are_bounded_where_one_id_repeats(spark, monkeypatch):
    """10,000 rows of one doc_id count once for each label or language, in any order of rows."""
    texts = [f"some words {i} of text number {i * 7}" for i in range(10_000)]
    hot = docs_frame(spark, texts).selectExpr("cast(2 as long) as doc_id", "text", "if(doc_id % 2 = 0, 'en', 'es') as lang")
    rest = docs_frame(spark, texts[:60], first=10).select("doc_id", "text", "lang")
    docs = hot.union(rest)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic").union(spark.createDataFrame([(2, 1)] * 40, "doc_id long, toxic int"))
    seen = []
    learn = toxicity.Ftrl.learn
    monkeypatch.setattr(toxicity.Ftrl, "learn", lambda self, found, label: (seen.append((tuple(found), label)), learn(self, found, label))[1])
    first = toxicity.train(docs, labels, 20)
    once = list(seen)
    assert 0 < len(once) <= 20 * toxicity.EPOCHS
    again = toxicity.train(docs.orderBy("text").repartition(3), labels, 20)
    assert seen[len(once):] == once and all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))
    sizes = []

    class Kept(language.Model):
        def __init__(self, languages, x, y):
            sizes.append(np.bincount(y).tolist())
            super().__init__(languages, x, y)

    monkeypatch.setattr(language, "Model", Kept)
    one, two = language.train(docs, 25), language.train(docs.orderBy("text").repartition(3), 25)
    assert max(max(s) for s in sizes) <= 25 and np.array_equal(one.w, two.w)


def test_toxicity_learns_from_every_labelled_document(spark):
    """Words that stand only in documents beyond the 20,000 smallest hashes are learned too."""
    ids = spark.range(30_000).selectExpr("id as doc_id").withColumn("h", common.hashed("toxicity"))
    known = ids.filter(common.fold_of(ids.doc_id, 4) != 2).orderBy("h").collect()
    late = {r.doc_id for r in known[20_000:]}
    assert len(late) > 1000
    rows = [(r.doc_id, f"{'late' if r.doc_id in late else 'early'} {'vile' if r.doc_id % 2 else 'calm'}", r.doc_id % 2) for r in known]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    learned = set(model[0].tolist())
    assert set(plain_features("early vile")) & learned
    assert (set(plain_features("late vile")) - set(plain_features("early vile"))) & learned


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_toxicity_is_the_mean_of_its_shards(spark, monkeypatch, broadcast_rows):
    """Against plain learners, one for each shard; the same for rows repeated and dealt in another way."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 25)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(("good", "bad", "calm", "vile")) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in enumerate(texts)] + [(i, 1) for i in range(5000, 5200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = sorted((r.h, r.doc_id) for r in docs.select("doc_id", common.hashed("toxicity").alias("h")).collect() if crc_fold(r.doc_id, 4) != 2)
    shards = -(-len(rows) // 25)
    want = {}
    for k in range(shards):
        own = [(texts[d], int("vile" in texts[d])) for h, d in rows if h % shards == k]
        for i, w in plain_ftrl(own).items():
            want[i] = want.get(i, 0.0) + w * len(own) / len(rows)
    got = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    assert shards > 2 and got.keys() == {i for i, w in want.items() if w}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
    again = toxicity.train(docs.union(docs).orderBy("text").repartition(7), labels.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(model, again, strict=True))


def test_language_learns_from_every_document(spark):
    """A language's second alphabet, only in documents beyond its 500 smallest hashes, is learned too."""
    rng = random.Random(9)
    marked = spark.range(4000).selectExpr("id as doc_id").withColumn("h", common.hashed("language")).orderBy("h").collect()
    texts, place = {}, {"en": 0, "es": 0}
    for r in marked:
        lang = "en" if r.doc_id % 2 else "es"
        place[lang] += crc_fold(r.doc_id, 3) != 1
        letters = {"en": ("abcd", "ijkl"), "es": ("efgh", "mnop")}[lang][place[lang] > 500]
        texts[r.doc_id] = (" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12)), lang)
    docs = spark.createDataFrame([(d, *t) for d, t in texts.items()], "doc_id long, text string, lang string")
    model = language.train(docs)
    late = spark.createDataFrame([(1, "ijkl lkij jilk kkil"), (2, "mnop ponm nmop oonp")], "doc_id long, text string")
    found = {r.doc_id: r for r in language.predict(late, model).collect()}
    assert (found[1].lang_pred, found[2].lang_pred) == ("en", "es") and not found[1].ambiguous and not found[2].ambiguous


def test_language_is_the_mean_of_its_shards(spark, monkeypatch):
    """Against models of the shards by hand, a rare language in each; the same for rows repeated and dealt in another way."""
    monkeypatch.setattr(language, "ROWS_PER_LANGUAGE", 20)
    rng = random.Random(10)
    of = [("en", "abcd", 150), ("es", "efgh", 90), ("fr", "ijkl", 6)]
    rows = [(" ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(10)), lang) for lang, a, n in of for _ in range(n)]
    docs = docs_frame(spark, [t for t, _ in rows], langs=[x for _, x in rows])
    model = language.train(docs)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", common.hashed("language").alias("h")).collect()}
    known = sorted((hashes[d], *rows[d]) for d in hashes if crc_fold(d, 3) != 1)
    names = ["en", "es", "fr"]
    n = [sum(x == lang for _, _, x in known) for lang in names]
    shards = round(sum(n) / 60)
    chunks = {lang: max(1, min(shards, c // 10)) for lang, c in zip(names, n, strict=True)}
    total, flat = 0, 0
    for s in range(shards):
        own = [(t, x) for h, t, x in known if h % chunks[x] == s % chunks[x]]
        x = np.stack([language.vector(language.counts(t)) for t, _ in own])
        flat = flat + len(own) * language.Model(names, x, np.array([names.index(v) for _, v in own])).flat()
        total += len(own)
    assert shards > 1 and chunks["fr"] == 1 and total == sum(n) + (shards - 1) * n[2]
    assert np.abs(model.flat() - flat / total).max() < 1e-3
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert all(found[d] == rows[d][1] for d in found)
    again = language.train(docs.union(docs).orderBy("text").repartition(7))
    assert np.array_equal(model.w, again.w) and np.array_equal(model.bit_weight, again.bit_weight)
