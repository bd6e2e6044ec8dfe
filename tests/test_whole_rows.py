"""Queries over all rows, without the filters that their SQL neighbours need, against brute force."""

import re
from collections import defaultdict

import pytest

from colloq.functions import text as T
from colloq.operators import conversation
from colloq.plans import registry

SF = "/root/testdata/sf0.001"
TURNS = [
    (1, 0, "system", "Hello, the café\nis shut. why?  ask (smile) of anyone"), (1, 1, "user", "hi"), (1, 2, "assistant", "Straße in Köln! the end"),
    (1, 3, "user", ""), (1, 4, "user", None), (1, 5, "user", "good morning bob, of course. yes"), (1, 6, "user", "the seventh turn " * 10),
    (1, 7, "assistant", "line\n> quoted\nmore"), (2, 0, "user", "  HEY you!  d'accord.\tnon? oui"), (2, 13, "user", "past twelve " * 10),
]


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{out}/conversations.parquet")
    docs = [(0, "Über Paris: naïve Zürcher met Élan and The 12.5 crew"), (1, "Straße 7, Köln"), (2, ""), (7, "Montréal 1999 London"), (8, "plain London")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    items = [(3, "paris in 12.5"), (5, "köln"), (90, "london")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.fixture(params=["fixture", "table"])
def place(request, fixture_dir):
    return fixture_dir if request.param == "fixture" else SF


def turns(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def same(found, want):
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def intent(text):
    lowered = (text or "").lower().strip(" ")
    if not lowered:
        return "casual", 1.0
    rest = re.sub(conversation._EDGES, "", re.sub(conversation.GREETING.replace("(?iU)", "(?i)"), "", lowered))
    best = (0.0, "")
    for name, rules in registry._RULES:
        score = max((w for p, w in rules if re.search(p, rest or lowered, re.I)), default=0.0)
        score = min(score + 0.1, 1.0) if score and name == "sensitive" else score
        best = (score, name) if score > best[0] else best
    return ("casual", 0.5) if best[0] < 0.5 else (best[1], round(best[0], 6))


def test_intents_of_all_turns(spark, place):
    want = [(c, t, *intent(x)) for c, t, _, x in turns(spark, place)]
    same(map(tuple, registry.QUERIES["intent_classify"](spark, place).drop("explanation").collect()), want)
    groups = defaultdict(list)
    for *_, name, confidence in want:
        groups[name].append(confidence)
    found = {r.intent: (r.n, r.mean_confidence) for r in registry.QUERIES["intent_counts"](spark, place).collect()}
    assert found == {k: (len(v), pytest.approx(sum(v) / len(v), abs=1e-6)) for k, v in groups.items()}


def capitalised(text):
    return re.sub(r"(^|[.!?]\s{1,9})(\w)", lambda m: m[1] + m[2].upper(), text)


def test_guardrails_of_all_turns(spark, place):
    def guarded(text):
        if text is None:
            return None
        text = re.sub(r"\bof\b\s*", "", re.sub(r"\([a-z_]+\)", "", text).strip(), flags=re.I)
        return capitalised(re.sub(r"\s{2,}", " ", text.strip()))

    found = registry.QUERIES["guardrail_pipeline"](spark, place).collect()
    same(map(tuple, found), [(c, t, guarded(x)) for c, t, _, x in turns(spark, place)])


def test_quotes_of_all_turns(spark, place):
    mark = re.compile(r"\s*>|On [^\n]{5,80} wrote:\s*$|-{2,}\s*Original Message|\s*--\s*$")

    def own(text):
        lines = f"{text}\nOn Monday you wrote:\n> {text}".split("\n")
        return "\n".join(lines[: next(i for i, x in enumerate(lines) if mark.match(x))]).strip(" \t\n\x0b\f\r")

    found = registry.QUERIES["strip_quoted"](spark, place).collect()
    same(map(tuple, found), [(c, t, None if x is None else own(x)) for c, t, _, x in turns(spark, place)])


def test_every_turn_is_a_source(spark, fixture_dir, place):
    found = {(r.request_id, r.part): r for r in registry.QUERIES["intent_sources_budget"](spark, place).collect()}
    assert set(found) == {(c, t // 6) for c, t, _, _ in turns(spark, place)}
    if place == fixture_dir:
        assert found[1, 1].context.startswith("[CALENDAR]\nthe seventh turn") and "[RAG]" in found[1, 1].context
        assert found[2, 2].context.startswith("[RAG]") or found[2, 2].dropped == "rag"


def claims(text):
    names = (T.fold_text(x) for x in re.findall(r"\b[Α-ΩΆΈΉΊΌΎΏA-Z][α-ωάέήίόύώϊϋΐΰa-z]{2,}\b", text))
    return {T.fold_text(x) for x in re.findall(r"\b\d[\d.,:/]*\b", text)} | {x for x in names if x not in ("and", "the")}


def test_claims_of_all_documents(spark, place):
    docs = [tuple(r) for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{place}/benchmark.parquet").orderBy("item_id").collect()]
    found = registry.QUERIES["claim_extract"](spark, place).collect()
    same(map(tuple, found), [(i, ",".join(sorted(claims(x or ""))), len(claims(x or ""))) for i, x in docs])
    want, used = [], set()
    for i, x in docs:
        own, k = claims(x or ""), i % len(items)
        used.add(k)
        want.append((i, round(sum(c not in T.fold_text(items[k]) for c in own) / len(own), 6) if own else 0.0))
    assert used == set(range(len(items)))
    same(map(tuple, registry.QUERIES["unsupported_specifics"](spark, place).collect()), want)
