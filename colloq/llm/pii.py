"""Personal data by candidate generation and boosted trees (operator 3).

Base rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers; their
spans always stay. Generators of high recall propose further, overlapping spans: anything around
an ``@`` or a spelled-out one, and every run of digits and separators, whole and cut at its
spaces. Gradient-boosted trees score a candidate by format features (length, digits, groups,
separators, leading zero, plus sign, brackets, Luhn) and context features (the characters beside
it, a cue word before it, its kind). What can be added are candidates that no base rule confirms, so
the trees learn from those only: candidates that touch no base span are 0, and positives are base
spans written without their deciding mark (``VARIANTS``: a spelled-out or spaced ``@``, no ``+``,
points in a card number, spaced points in an address), one way for each span, by its hash. They
learn from all documents of one half, by a hash of doc_id; over all candidates and variants of the
other half a threshold is calibrated for each kind: the lowest score from which precision, by its
exact lower confidence bound, is at least ``PRECISION``. Examples with equal features, clipped as the trees see them,
are counted in Spark. Candidates at or above it that touch no
base span are added (kinds ``likely_*``), best score first. A kind with too little evidence adds
nothing. The precision is that of this mix of derived positives and real candidates.

Spans are kind:start:end in code points, end exclusive, by start, then kind in the order of
``KINDS``. Defined results: a null or empty text has no spans; rows are scanned one by one, so
null or repeated doc_ids are fine (a null doc_id is not learned from); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import hashed, slices, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, *(f"likely_{k}" for k in BASE_KINDS))
PRECISION, CONFIDENCE = 0.9, 0.95
#: Documents whose texts and candidates a worker holds at once.
SLICE = 512

#: The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

_RUN = re.compile(r"[+(]?[0-9][\x20().0-9/-]*[0-9]")
_SPELLED = re.compile(r"\x20?@|\x20?[(\[{](?:at|AT)[)\]} ]|\x20(?:at|AT)[)\]} ]")
_DOT, _LABEL = r"(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)", "[A-Za-z0-9-]{1,63}"
_AFTER_AT = re.compile(
    rf"\x20?{_LABEL}(?:(?:{_DOT}{_LABEL}){{0,6}}{_DOT}[A-Za-z]{{2,24}}|\x20?(?:\.|[(\[{{]dot[)\]}}]|\x20dot\x20)\x20?[A-Za-z]{{2,24}})"
)
_CUE = re.compile(r"(?i)(mail|contact|write)|(\bip\b|addr|host|server)|(card|visa|credit|karte|carte|tarjeta)|(phone|tel|call|mobile|fax)")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what may be personal data; spans may overlap."""
    found = set()
    for m in _SPELLED.finditer(text):
        if tail := _AFTER_AT.match(text, m.end()):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                found.add((start, 0, tail.end()))
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        pieces, at = [(m.start(), m.end())], m.start()
        for part in m.group().split(" "):
            pieces.append((at, at + len(part)))
            at += len(part) + 1
        for a, b in pieces:
            part = text[a:b]
            n = sum(map(len, _DIGITS.findall(part)))
            if n < 7 or n > 40:
                continue
            kind = 1 if part.count(".") == 3 and n <= 12 else 2 if n >= 12 and part[:1] not in "+(" else 3
            found.add((a, kind, b))
    return sorted(found)


def features(text: str, span: tuple[int, int, int]) -> list[int]:
    a, kind, b = span
    part, before = text[a:b], text[max(0, a - 24) : a]
    groups = _DIGITS.findall(part)
    digits = "".join(groups)
    cue = _CUE.search(before)
    beside = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    return [
        kind, len(part), len(digits), len(groups), max(map(len, groups), default=0), part.count(" "), part.count("-"),
        part.count("."), part.count("("), int(part[:1] == "+"), int(digits[:1] == "0"), int(luhn(digits)) if digits else 0,
        int("@" in part), beside(text[a - 1 : a] if a else ""), beside(text[b : b + 1]), cue.lastindex or 0 if cue else 0,
        max((int(g) for g in groups if len(g) < 4), default=0) // 16,
    ]


def _spelled(at: str, dot: str):
    return lambda s: s.replace("@", at).replace(".", dot) if dot == "." else s.split("@")[0] + at + s.split("@")[1].replace(".", dot)


#: Per base kind, ways to write a span without the mark by which its base rule knows it.
VARIANTS = (
    (_spelled(" (at) ", " dot "), _spelled("[at]", "."), _spelled(" at ", " dot "), _spelled(" @ ", ".")),
    (lambda s: s.replace(".", " . "),),
    (lambda s: ".".join(d[i : i + 4] for d in [re.sub(r"[\x20-]", "", s)] for i in range(0, len(d), 4)),),
    (lambda s: s[1:], lambda s: "00" + s[1:]),
)


def variant(text: str, span: tuple[int, int, int]) -> list[int] | None:
    """Features of a base span in its place, written in another way; none if no candidate comes of it."""
    a, kind, b = span
    ways = VARIANTS[kind]
    new = ways[zlib.crc32(text[a:b].encode("utf-8", "surrogatepass")) % len(ways)](text[a:b])
    before = text[max(0, a - 80) : a]
    place, start, end = before + new + text[b : b + 40], len(before), len(before) + len(new)
    if (start, kind, end) not in candidates(place) or any(x < end and y > start for x, _, y in base_spans(place)):
        return None
    return features(place, (start, kind, end))


def examples(text: str) -> list[list[int]]:
    """Features and label of every variant of a base span and of every candidate that touches none."""
    base = base_spans(text)
    out = [[*f, 1] for s in base if (f := variant(text, s))]
    return out + [[*features(text, s), 0] for s in untouched(candidates(text), base)]


def untouched(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the sorted spans that touch no base span."""
    out, i = [], 0
    for s in found:
        while i < len(base) and base[i][2] <= s[0]:
            i += 1
        if not any(b[0] < s[2] and b[2] > s[0] for b in base[i : i + 8]):
            out.append(s)
    return out


class Model:
    """Trees and a threshold per kind (above 1: the kind adds nothing)."""

    def __init__(self, trees: boosting.Boosted | None):
        self.thresholds = np.full(len(BASE_KINDS), 2.0)
        self.trees = trees

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In thousandths, as thresholds are."""
        return np.round(self.trees.predict(x), 3)


def calibrated(score: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> float:
    """The lowest score from which the exact lower bound of precision is PRECISION or more."""
    best, a = 2.0, 1 - PRECISION
    count = np.ones(len(y), np.int64) if count is None else count
    for t in np.unique(np.round(score, 3))[::-1]:
        taken = score >= t
        n, wrong = int(count[taken].sum()), int((count * (1 - y))[taken].sum())
        if wrong <= n * a:
            # The binomial tail downwards from its largest term; terms beyond 40 deviations are zero in doubles.
            most = math.lgamma(n + 1) - math.lgamma(wrong + 1) - math.lgamma(n - wrong + 1) + wrong * math.log(a) + (n - wrong) * math.log(1 - a)
            i = np.arange(wrong, max(0, wrong - 40 * math.isqrt(n) - 40), -1)
            tail = math.exp(most) * (1 + np.cumprod(i * (1 - a) / ((n - i + 1) * a)).sum())
            if tail <= 1 - CONFIDENCE:
                best = float(t)
    return best


#: Features of an example.
_WIDTH = len(features("", (0, 0, 0)))


def train(docs: DataFrame) -> Model:
    """Learn from all documents: trees from one half, thresholds from the other, by a hash of doc_id."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            ids, found = [], []
            for d, text in zip(batch.column(0), batch.column(1), strict=True):
                if own := examples(text.as_py() or ""):
                    table = np.array(own)
                    rows = np.column_stack([boosting.clipped(table[:, :-1]), table[:, -1].astype(np.uint8)])
                    ids.append(d)
                    found.append([{"x": r[:-1], "y": r[-1], "n": n} for r, n in sorted(Counter(map(bytes, rows)).items())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, examples_of)], ["doc_id", "f"])

    examples_of = pa.list_(pa.struct([("x", pa.binary()), ("y", pa.int32()), ("n", pa.int64())]))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    counted = known.mapInArrow(extract, "doc_id long, f array<struct<x: binary, y: int, n: long>>")
    # A doc_id counts once, by the text whose examples are greatest; equal ones meet map-side first.
    one = counted.groupBy("doc_id").agg(F.max("f").alias("f")).select((hashed("pii") % 2).alias("half"), F.explode("f").alias("f"))
    table = written(one.groupBy("half", "f.x", "f.y").agg(F.sum("f.n").alias("n")), "pii")
    model = Model(boosting.fit(table.filter("half = 0").drop("half"), _WIDTH))
    if model.trees is None:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = boosting.unpacked(batch.column(0), _WIDTH)
            columns = [pa.array(own[:, 0].astype(np.int64)), pa.array(shared.value.scores(own)), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "score", "y", "n"])

    # All of them count; what comes back is one row per kind, thousandth and label.
    held = table.filter("half = 1").select("x", "y", "n").mapInArrow(judge, "kind long, score double, y int, n long")
    held = held.groupBy("kind", "score", "y").agg(F.sum("n").alias("n")).collect()
    for kind in range(len(BASE_KINDS)):
        own = np.array([(r.score, r.y, r.n) for r in held if r.kind == kind]).reshape(-1, 3)
        model.thresholds[kind] = calibrated(own[:, 0], own[:, 1].astype(np.int64), own[:, 2].astype(np.int64))
    return model


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """Spans that the trees add to each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model.trees is None or (model.thresholds > 1).all():
        return out
    proposed, rows = [], []
    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        for s in untouched([s for s in candidates(text) if model.thresholds[s[1]] <= 1], base):
            proposed.append((k, s))
            rows.append(features(text, s))
    if not rows:
        return out
    score = model.scores(np.array(rows))
    for j in np.argsort(-score, kind="stable").tolist():
        k, (a, kind, b) = proposed[j]
        if score[j] >= model.thresholds[kind] and not any(x < b and y > a for x, _, y in out[k]):
            out[k].append((a, len(BASE_KINDS) + kind, b))
    return out


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, a count per base kind, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, shared.value)
            name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            counts = [pa.array([sum(1 for s in b if s[1] == k) for b in bases], pa.int64()) for k in range(len(BASE_KINDS))]
            digest = [hashlib.sha256(name(b).encode()).hexdigest() for b in bases]
            spans = [name(sorted(b + m)) for b, m in zip(bases, more, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array([len(m) for m in more], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return rows.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    out, at, k = [], 0, 0
    spans = sorted(spans)
    while k < len(spans):
        a, kind, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[at:a], f"[{BASE_KINDS[kind % len(BASE_KINDS)].upper()}]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every found span of ``text`` masked; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            texts = batch.column(at).to_pylist()
            bases = [base_spans(t or "") for t in texts]
            more = added_spans([t or "" for t in texts], bases, shared.value)
            new = [t and masked(t, b + m) for t, b, m in zip(texts, bases, more, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
