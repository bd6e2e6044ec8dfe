import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloq.operators import agency, claims, conversation, dataset, medallion, metrics, privacy, search

NOW = dt.datetime(2026, 8, 24, 8)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def messages(spark, rows):
    return spark.createDataFrame(rows, "timestamp string, chat_id string, sender string, is_me boolean, text string")


def test_silver_and_gold(spark):
    rows = [
        ("2026-01-01 10:00:00", "c1", "a", False, "τι κάνεις"), ("2026-01-01 10:01:00", "c1", "me", True, "καλά εσύ"),
        ("2026-01-01 14:01:00", "c1", "a", False, "exactly four hours"), ("2026-01-01 18:01:01", "c1", "a", False, "one second more"),
        ("2026-01-01 18:02:00", "c1", "me", True, "x"), ("garbage", "c1", "a", False, "lost"), ("2026-01-01 10:00:00", "c1", "a", False, "   "),
        ("2026-01-01 10:00:00", "c0", "a", False, "τι κάνεις"),
    ]
    silver = medallion.silver(messages(spark, rows)).orderBy("ts").collect()
    assert [(r.chat_id, r.thread_id, r.language) for r in silver] == [("c0", 1, "el"), ("c1", 1, "el"), ("c1", 1, "en"), ("c1", 2, "en"), ("c1", 2, "en")]
    rows[-1] = ("2026-01-01 10:00:30", "c1", "a", False, "ok")
    gold = medallion.gold_pairs(medallion.silver(messages(spark, rows))).collect()
    assert [(r.instruction, r.response) for r in gold] == [("ok", "καλά εσύ")]
    chunk = medallion.gold_chunks(medallion.gold_pairs(medallion.silver(messages(spark, rows)))).first()
    assert chunk.chunk_text == "ok → καλά εσύ" and len(chunk.embedding) == 16


def test_pairs_and_feedback(spark):
    f = spark.createDataFrame([("", "b", "a", None), ("i", "r", None, None), (None, None, "x", "y")], "instruction string, response string, instruction_clean string, response_clean string")
    assert sorted(tuple(r) for r in medallion.normalised_pairs(f).collect()) == [("a", "b"), ("i", "r"), ("x", "y")]
    log = spark.createDataFrame([("t", "m", "r", 1, ""), ("t", "m", "r", 1, "c"), ("t", "m", "r", -1, None), ("t", "m", "r", 0, None)], "timestamp string, message string, reply string, rating int, correction string")
    assert sorted(r.response for r in medallion.feedback_pairs(log).collect()) == ["c", "r"]
    assert medallion.pending_reviews(log).count() == 2


def test_bm25(spark):
    docs = spark.createDataFrame(list(enumerate(["ο σκύλος γαβγίζει όλη νύχτα", "η γάτα κοιμάται στον καναπέ", "completely unrelated english text"])), "doc_id long, text string")
    q = spark.createDataFrame([(1, "σκύλος")], "query_id long, query string")
    assert [r.id for r in search.bm25_top(docs, q, 3).collect()] == [0]
    index = search.build_index(docs)
    scored = search.scores(index, search.query_terms(q, "query_id", "query"))
    assert [r.id for r in search.ranked_with_zeros(index, scored, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.id for r in search.ranked_with_zeros(index, scored, q, 1).collect()] == [0]
    many = spark.range(1500).selectExpr("id as query_id", "if(id = 7, 'γάτα english', 'nothing') as query")
    top = search.ranked_with_zeros(index, search.scores(index, search.query_terms(many, "query_id", "query")), many, 2).collect()
    assert len(top) == 3000 and [r.id for r in sorted(top, key=lambda r: r.rank) if r.query_id == 7] == [2, 1]
    assert {(r.rank, r.id) for r in top if r.query_id != 7} == {(1, 0), (2, 1)}


def test_index_saved_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    search.build_index(docs).save(str(tmp_path / "index"))
    again = search.Index.load(spark, str(tmp_path / "index"))
    assert {(r.id, r.term, r.tf) for r in again.postings.collect()} == {(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 1)}


def test_rrf_and_gate(spark):
    legs = spark.createDataFrame([(1, "a", i, r + 1) for leg in ([1, 2, 3], [1, 3, 2]) for r, i in enumerate(leg)], "query_id long, leg string, id long, rank int")
    assert {r.id: r.score for r in search.rrf(legs).collect()}[1] == pytest.approx(2 / 61)
    lex = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "query_id long, id long, score double")
    vec = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0)], "query_id long, id long, score double")
    assert [r.id for r in search.hybrid(lex, vec, 5).collect()] == [0]
    assert [r.id for r in search.hybrid(lex, None, 5).orderBy("rank").collect()] == [1, 0]
    assert search.status(None, False) == "no_corpus_configured" and search.status("x", True) == "ok"


HUMAN = ["Θα το κάνω αύριο", "Ναι, πάω σπίτι", "Δεν ξέρω, θα δω", "Είμαι στη δουλειά"]
ASSISTANT = ["Πώς μπορώ να σας βοηθήσω σήμερα;", "Είμαι εδώ για να βοηθήσω!", "Ως τεχνητή νοημοσύνη δεν έχω γνώμη.", "Πώς μπορώ να σας βοηθήσω;"]


def profile(spark, texts):
    return metrics.style_profile(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_style_profile_of_a_null_group(spark):
    rows = spark.createDataFrame([(None, "one two two"), ("g", "θέλω τρία"), ("g", None)], "k string, text string")
    found = {r.k: (round(r.type_token_ratio, 6), r.first_person_rate, r.n_samples) for r in metrics.style_profile(rows, ["k"]).collect()}
    assert found == {None: (0.666667, 0.0, 1), "g": (1.0, 1.0, 1)}


def test_style(spark):
    human, tool = profile(spark, HUMAN).first(), profile(spark, ASSISTANT).first()
    assert human.first_person_rate == 1.0 and human.assistant_tell_rate == 0 and tool.assistant_tell_rate == 1.0 and human.greek_ratio == 1.0
    both = profile(spark, HUMAN).alias("a").join(profile(spark, ASSISTANT).alias("b"))
    assert 0.15 < both.select(metrics.style_distance("a", "b").alias("d")).first().d < 1
    same = profile(spark, HUMAN).alias("a").join(profile(spark, HUMAN).alias("b"))
    assert same.select(metrics.style_distance("a", "b").alias("d")).first().d == 0


def test_rates_and_diversity(spark):
    f = spark.createDataFrame([("Δεν ξέρω",), ("as an AI",), (" ",), ("καλά",)], "text string")
    r = metrics.reliability(f).first()
    assert (r.refusal_rate, r.drift_rate, r.empty_rate, r.n) == (0.25, 0.25, 0.25, 4)
    assert metrics.reliability(f.limit(0)).first().refusal_rate == 0
    assert one(spark, "a b c a b c a b c", metrics.repetition_rate) > 0.3 and one(spark, "a", metrics.repetition_rate) == 0
    d = metrics.distinct_n(spark.createDataFrame([("a b a b",)], "text string"), 2).first()
    assert (d.distinct_2, d.n_grams) == (pytest.approx(2 / 3), 3)
    sim = metrics.mean_similarity(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "z")], "id long, text string"), "id", "text").first()
    assert sim.mean_similarity == pytest.approx(1 / 3)


def test_grounding(spark):
    ctx = "Η συνάντηση είναι στις 18:30 με τον Νίκο στο γραφείο"
    f = spark.createDataFrame([("Ναι.", ""), ("συνάντηση γραφείο", ctx), ("Στις 19:00 με τον Νίκο", ctx), (ctx, ctx), ("εντελώς άλλα λόγια εδώ πέρα", ctx)], "r string, c string")
    rows = f.select(metrics.grounding_score(F.col("r"), F.col("c")).alias("g"), metrics.unsupported_specifics(F.col("r"), F.col("c")).alias("u"), metrics.verbatim_overlap(F.col("r"), F.col("c")).alias("v")).collect()
    assert rows[0].g == 1.0 and rows[1].g == 1.0 and rows[2].u == pytest.approx(1 / 3) and rows[3].v == 1.0 and rows[4].v == 0.0 and rows[0].u == 0.0


def test_latency_scaling_instability(spark):
    f = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "s double")
    r = metrics.latency(f, "s").first()
    assert (r.mean_s, r.median_s, r.p95_s) == (4.0, 2.5, 10.0)
    rows = {r.num_workers: r for r in metrics.scaling(spark.createDataFrame([(1, 1840.0), (4, 545.0)], "num_workers int, seconds double")).collect()}
    assert rows[4].speedup == pytest.approx(3.376, abs=1e-3) and rows[4].efficiency == pytest.approx(0.844, abs=1e-3)
    assert metrics.scaling(spark.createDataFrame([(1, 100.0), (2, 40.0)], "num_workers int, seconds double")).agg(F.max("overhead_s")).first()[0] == 0
    cells = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", True), ("c", True)], "q string, ok boolean")
    assert {r.q: (r.p, r.mixed) for r in metrics.instability(cells, ["q"], F.col("ok")).collect()} == {"a": (0.5, True), "c": (1.0, False)}


def test_zip_checks_length(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos long, l string")
    assert metrics.zip_checked(a, a.withColumnRenamed("l", "r"), "pos").count() == 2
    with pytest.raises(Exception, match="differ in length"):
        metrics.zip_checked(a, a.limit(1).withColumnRenamed("l", "r"), "pos").collect()


CONTACTS = ["Γιώργος Παπαδόπουλος", "Νίκος", "Μαρία", "Κώστας"]


@pytest.mark.parametrize(
    "text, masked",
    [
        ("ΑΦΜ 123456783 εδώ", "ΑΦΜ [ΑΦΜ] εδώ"), ("ΑΦΜ 123456784 εδώ", "ΑΦΜ 123456784 εδώ"),
        ("αμκα 01018012345", "αμκα [ΑΜΚΑ]"), ("αμκα 99999912345", "αμκα 99999912345"), ("GR1601101250000000012300695", "[IBAN]"),
        ("πάρε 6912345678", "πάρε [ΤΗΛΕΦΩΝΟ]"), ("+30 6912345678", "[ΤΗΛΕΦΩΝΟ]"), ("2101234567", "[ΤΗΛΕΦΩΝΟ]"), ("test.user@example.gr", "[EMAIL]"),
        ("Ο Γιώργος και ο Νίκος ήρθαν χθες.", "Ο [ΟΝΟΜΑ] και ο [ΟΝΟΜΑ] ήρθαν χθες."),
        ("Πες του Γιώργου να πάρει τον Κώστα τηλέφωνο.", "Πες του [ΟΝΟΜΑ] να πάρει τον [ΟΝΟΜΑ] τηλέφωνο."),
        ("Καλημέρα! Ευχαριστώ πολύ. Καλό Πάσχα!", "Καλημέρα! Ευχαριστώ πολύ. Καλό Πάσχα!"), (None, None),
    ],
)
def test_sanitise(spark, text, masked):
    assert one(spark, text, lambda x: privacy.sanitise(x, CONTACTS)) == masked


def test_sanitise_records_report_gate(spark):
    f = spark.createDataFrame([("Ο Νίκος 6912345678", 1), ("τίποτα", 2)], "t string, n int")
    rows = {r.n: r for r in privacy.sanitise_records(f, ["t", "n"], CONTACTS).collect()}
    assert rows[1].changed and not rows[2].changed and rows[1].t == "Ο [ΟΝΟΜΑ] [ΤΗΛΕΦΩΝΟ]"
    assert [tuple(r) for r in privacy.residual(f, ["t"]).collect()] == [("phone", 1)]
    with pytest.raises(ValueError):
        privacy.gate(privacy.residual(f, ["t"]))
    privacy.gate(privacy.residual(f.filter("n = 2"), ["t"]))


@pytest.mark.parametrize("text, hits", [("γιωτα μολις ειδα κ αλλο προιον", 1), ("παναγιωτη ελα εδω", 1), ("η νίκη ήταν σημαντική", 0), ("τι ώρα λέμε", 0), ("την Παρασκευή", 0), ("ο Νίκος", 1)])
def test_given_names(spark, text, hits):
    assert one(spark, text, privacy.redact_given_names).count("[NAME]") == hits


@pytest.mark.parametrize("word, yes", [("Παπαδόπουλος", True), ("παπαδοπουλου", True), ("Νικολαΐδης", True), ("επειδή", False), ("πτυχιακή", False), ("κοτόπουλο", False), ("Θεσσαλονίκη", False), ("ακης", False)])
def test_surnames(spark, word, yes):
    assert one(spark, word, privacy.surname) is yes
    assert one(spark, "Συρμακέσης", lambda x: privacy.surname(x, gazetteer=["συρμακεσ"]))
    assert one(spark, "Παπαδάκης!", lambda x: privacy.redact_surnames(x)) == "[SURNAME]!"


@pytest.mark.parametrize(
    "text, intent",
    [
        ("", "casual"), ("τι θα κάνεις αύριο το απόγευμα;", "schedule"), ("καλησπέρα γιώργο, τι θα κάνεις αύριο το απόγευμα;", "schedule"), ("καλησπέρα", "casual"),
        ("ποιο είναι το iban σου", "sensitive"), ("τι καιρό κάνει", "weather"), ("ποιος είσαι", "personal"), ("τι μου έλεγες για το σπίτι", "knowledge"),
        ("zzz qqq", "casual"), ("έκανες commit στο repo;", "devops"), ("tracking για την παραγγελία", "memory"),
    ],
)
def test_intents(spark, text, intent):
    assert one(spark, text, conversation.intent).intent == intent


def test_intent_confidence_and_keywords(spark):
    assert one(spark, "", conversation.intent).confidence == 1.0
    r = one(spark, "iban", conversation.intent)
    assert r.confidence == pytest.approx(0.95) and r.keywords == ["iban"]
    assert one(spark, "zzz", conversation.intent).confidence == 0.5


@pytest.mark.parametrize("role, register", [("ο καθηγητής μου", "academic"), ("συνάδελφο", "professional"), ("φίλος", "close"), ("", "neutral"), (None, "neutral"), ("άγνωστος τύπος", "neutral")])
def test_registers(spark, role, register):
    assert one(spark, role, conversation.register) == register


@pytest.mark.parametrize(
    "text, out",
    [("Ναι [NAME]", "Ναι"), ("ειναι καλα (laugh)", "Είναι καλά"), ("παναγιωτη τι λες", "Τι λες"), ("να πάρω και την [NAME] το απόγευμα", "Να πάρω και το απόγευμα"), ("ρε τι λες", "Τι λες"), ("όλα καλά", "Όλα καλά")],
)
def test_guard(spark, text, out):
    assert one(spark, text, conversation.guard) == out


def test_vocatives_go_in_formal_registers_only(spark):
    assert one(spark, "Φίλε, όλα καλά", lambda x: conversation.sanitise_output(x, F.lit("academic"))) == "όλα καλά"
    assert one(spark, "Φίλε, όλα καλά", lambda x: conversation.sanitise_output(x, F.lit("close"))) == "Φίλε, όλα καλά"


def test_context_budget(spark):
    rows = [(1, "schedule", "calendar", "ok", "λέξη " * 100), (1, "schedule", "rag", "ok", "παλιά " * 50), (1, "schedule", "email", "failed", ""),
            (2, "schedule", "calendar", "failed", None), (2, "schedule", "rag", "ok", "παλιά " * 50), (2, "schedule", "news", "ok", "νέα " * 20), (3, "sensitive", "rag", "ok", "x y z")]
    out = {r.request_id: r for r in conversation.assemble_context(spark.createDataFrame(rows, "request_id int, intent string, name string, status string, text string"), 70).collect()}
    assert out[1].total_words == 60 and out[1].dropped == ["rag"] and out[1].context.startswith("[CALENDAR]\nλέξη")
    assert out[2].dropped == ["rag"] and out[2].total_words == 20 and 3 not in out


def test_last_turns(spark):
    f = spark.createDataFrame([(list(range(15)),), ([1, 2],)], "t array<int>")
    assert [r[0] for r in f.select(conversation.last_turns(F.col("t"))).collect()] == [list(range(5, 15)), [1, 2]]


def test_claim_checks(spark):
    rules = [(r"gpt-?4", "no commercial model"), (r"django", "other framework")]
    assert one(spark, "χρησιμοποιεί GPT-4", lambda x: claims.denied(x, rules)) == ["no commercial model"]
    assert one(spark, "δεν χρησιμοποιεί GPT-4", lambda x: claims.denied(x, rules)) == []
    assert one(spark, "LoRA (Long Range)", lambda x: claims.acronyms(x, {"LoRA": ["low-rank"]})) == ["Το LoRA δεν σημαίνει «long range» — είναι low-rank"]
    assert one(spark, "LoRA (Low-Rank Adaptation)", lambda x: claims.acronyms(x, {"LoRA": ["low-rank"]})) == []
    assert one(spark, "React και Docker", lambda x: claims.unsupported_names(x, F.lit("docker"), ["react", "docker"])) == ["react"]
    assert one(spark, "Node.js", lambda x: claims.canonical_name(x, ["nodejs"])) == "nodejs" and one(spark, "python3.11", lambda x: claims.canonical_name(x, ["python"])) == "python"
    found = claims.corrupted_names(spark.createDataFrame([("use databriks and docker",)], "t string"), "t", ["databricks", "docker"]).collect()
    assert [(r.token, r.name) for r in found] == [("databriks", "databricks")]
    assert one(spark, "Είμαι σπίτι. Θα έρθεις;", lambda x: claims.asserts(x, "σπίτι")) and not one(spark, "Είσαι σπίτι;", lambda x: claims.asserts(x, "σπίτι"))


SIGNAL = "g int, pos int, source string, key string, summary string, urgency int, occurs_at timestamp, detail string"


def test_signals(spark):
    now = F.lit(NOW).cast("timestamp")
    rows = [(1, i, "calendar", f"k{i}", "τίποτα", 1, None, "") for i in range(5)] + [(2, 0, "email", "", "Deadline σήμερα", 3, None, "στις 5"), (2, 1, "email", "", "deadline  ΣΉΜΕΡΑ", 3, None, "")]
    f = spark.createDataFrame(rows, SIGNAL)
    assert {r.g: r.speaks for r in agency.should_speak(f, ["g"], "pos", now).collect()} == {1: False, 2: True}
    said = agency.dedupe(f, ["g"], "pos").select("g", "identity")
    assert agency.should_speak(f, ["g"], "pos", now, said).count() == 0
    out = {r.g: r for r in agency.briefing(f, ["g"], "pos", now).collect()}
    assert out[1].status == "silent_below_threshold" and out[1].text == ""
    assert out[2].text == "Καλημέρα. Δευτέρα 24 Αυγούστου.\n\n⏱ Deadline σήμερα — στις 5" and out[2].status == "spoke"
    gone = spark.createDataFrame([(1, "calendar"), (3, "email")], "g int, source string")
    out = {r.g: r for r in agency.briefing(f, ["g"], "pos", now, gone).collect()}
    assert out[1].status == out[3].status == "spoke_degraded" and "το ημερολόγιο" in out[1].text


def test_training_sets(spark):
    f = spark.range(100).withColumnRenamed("id", "doc_id")
    parts = {r.part: r.n for r in dataset.split(f, "doc_id").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"val": 10, "train": 90}
    assert dataset.split(f.limit(1), "doc_id").first().part == "val"
    assert [r.worker for r in dataset.shard(f.limit(6), "doc_id", 2).orderBy("doc_id").collect()] == [0, 1, 0, 1, 0, 1]
    sizes = [r.n for r in dataset.shard(spark.range(101).withColumnRenamed("id", "doc_id"), "doc_id", 4).groupBy("worker").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 101 and max(sizes) - min(sizes) <= 1
    assert dataset.oversample(f, f.limit(2)).count() == 106
    assert "[INST] a [/INST] b" in one(spark, "a", lambda x: dataset.template(x, F.lit("b"), "mistral"))
    assert dataset.effective_batch(4, 8, 2) == 64


def test_nothing_remains_after_the_masks(spark):
    rows = spark.createDataFrame([("ΑΦΜ 090000045 mail a@b.gr τηλ 6912345678",), (None,)], "text string")
    assert {r.category for r in privacy.residual(rows, ["text"]).collect()} == {"afm", "email", "phone"}
    assert privacy.residual(privacy.sanitise_records(rows, ["text"]), ["text"]).isEmpty()
    with pytest.raises(ValueError):
        privacy.gate(privacy.audit_names(spark.createDataFrame([("ο Γιάννης",)], "text string"), ["text"]))
    privacy.gate(privacy.audit_names(spark.createDataFrame([("την Παρασκευή",)], "text string"), ["text"]))


def test_translation_is_for_the_vector_leg_alone(spark):
    q = spark.createDataFrame([(1, "γάτα")], "query_id long, query string")
    r = search.embedded_queries(q, lambda c: F.array(F.length(c).cast("double")), lambda c: F.concat(c, F.lit("!"))).first()
    assert (r.query, r.vector) == ("γάτα", [5.0])
    assert search.embedded_queries(q, lambda c: F.array(F.length(c).cast("double"))).first().vector == [4.0]


def test_half_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double").select(metrics.rounded(F.col("x"), 0)).collect()
    assert [r[0] for r in got] == [0.0, 2.0, 2.0, -0.0]


def test_clean_verified_writes_only_clean_rows(spark, tmp_path):
    rows = spark.createDataFrame([("ο Παπαδόπουλος ήρθε",), ("καλά",)], "text string")
    privacy.clean_verified(rows, ["text"], f"{tmp_path}/out")
    assert sorted(r.text for r in spark.read.json(f"{tmp_path}/out").collect()) == ["καλά", "ο [SURNAME] ήρθε"]


def test_surname_rules_fold_a_token_once(spark):
    """Each rule looks at one folded form (F10); results are those of the rules over folded tokens."""
    from colloq.operators import privacy

    lists = {"gazetteer": ("stati",), "own": ("motion",), "suffixes": ("tion",), "adjectival": ("ing",), "ordinary": ("station",), "places": ("action",)}
    words = ["Nation", "nátion", "STATIONS", "station", "action", "motion", "ßßa", "ßation", "tion", "a", "Stating", "", "İtion"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in frame.select(privacy.surname(F.col("w"), **lists)).collect()]
    assert got == [True, True, True, True, False, False, False, True, False, False, True, False, True]
    plan = frame.select(privacy.surname(F.col("w"), **lists))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") <= 2


def test_overlap_joins_only_words_that_both_texts_have(spark):
    """An n-gram is put together where all inner words are the context's (F13, F15); first and last words may be parts of its words."""

    def words(t):
        return F.split(F.lower(t), " ")

    rows = [("a b c d e f", "xa b c d ey"), ("a b c d e", "a b x c d e"), ("q r s t u v w", "r s t u v"), ("a b", "a b"), ("a b c d e", None)]
    frame = spark.createDataFrame(rows, "r string, c string")
    overlap = metrics.verbatim_overlap(F.col("r"), F.col("c"), words=words, fold=lambda t: t)
    got = [r[0] for r in frame.select(overlap).collect()]
    want = []
    for r, c in rows:
        w, inside = r.split(" "), c or ""
        grams = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        want.append(sum(g in inside for g in grams) / len(grams) if grams else 0.0)
    assert got == want and want[0] == 0.5
    assert "array_intersect" in frame.select(overlap)._jdf.queryExecution().toString()


def test_claims_look_at_the_first_character_first(spark):
    """The same claims as by boundaries alone (F13)."""
    from colloq.functions import text as T

    texts = ["x9 9x 12:30, 7.", "Ανna Ann Ab ABC Άννα'Bob", "_Tom Tom_ é1 1é ٣4 A1bc", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [r"(?U)\b\d[\d.,:/]*\b", r"(?U)\b[Α-ΩΆΈΉΊΌΎΏA-Z][α-ωάέήίόύώϊϋΐΰa-z]{2,}\b"]
    numbers, names = (F.regexp_extract_all("t", F.lit(p), 0) for p in plain)
    want = F.array_distinct(F.concat(F.transform(numbers, T.fold), F.transform(names, T.fold)))
    claims_ = T.checkable_claims(F.col("t"), ())
    assert all(r[0] == r[1] for r in frame.select(claims_, want).collect())
    assert frame.select(claims_)._jdf.queryExecution().toString().count("(?=") >= 2


def test_scores_shuffle_postings_and_no_pairs(spark):
    """A pair of query and document is added up where the document's postings are (F9, F11); with too many terms to broadcast, the same scores."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 7}" for k in range(1, 9))) for i in range(40)], "doc_id long, text string")
    terms = search.query_terms(spark.createDataFrame([(1, "w1 w2 w1"), (2, "w3 zz"), (3, "zz")], "q long, t string"), "q", "t")
    found = search.scores(search.build_index(docs), terms)
    got = {(r.query_id, r.id): round(r.score, 9) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and not any("hashpartitioning(query_id#" in line and ", id#" in line.split("hashpartitioning")[1] for line in plan.splitlines())
    most, search.BROADCAST_TERMS = search.BROADCAST_TERMS, 0
    try:
        plain = {(r.query_id, r.id): round(r.score, 9) for r in search.scores(search.build_index(docs), terms).collect()}
    finally:
        search.BROADCAST_TERMS = most
    assert got == plain and got and {q for q, _ in got} == {1, 2}
