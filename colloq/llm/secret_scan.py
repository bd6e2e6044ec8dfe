"""Secret scan (operator 1): keyword automaton, anchored patterns, embedded checksums.

One Aho-Corasick pass over the lower-cased text finds keyword hits; a pattern is tried only at a
hit. Tokens that carry a checksum of their own body (kinds ``github`` and ``npm``: the last six
characters are the base-62 CRC-32 of the thirty before them) count only if it holds. Runs of hex
digits have no keyword; they are found by looking at every 24th character, since a run of 24
cannot pass between two of them, and growing to both sides.

Spans are kind:start:end in code points, end exclusive. Kinds in order: assign, access, hex (the
base), github, npm (added). Defined results: a null or empty text has no spans; each row is
scanned by itself, so null or repeated doc_ids and any row order are fine; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

#: Keywords, patterns and least lengths of the base kinds.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_TAIL = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Prefixes of tokens that end in a checksum.
_CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
_CHECKED_BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])")

_HEX = frozenset("0123456789abcdef")
_HEX_RUN = re.compile("[0-9a-f]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for word in _ASSIGN_WORDS:
            auto.add_word(word, ("assign", len(word)))
        auto.add_word("akia", ("access", 4))
        for prefix in _CHECKED:
            auto.add_word(prefix, ("checked", len(prefix)))
        auto.make_automaton()
        _AUTOMATON = auto
    return _AUTOMATON


def checksum(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    n, at, step = len(text), 0, _LEAST["hex"]
    for k, c in enumerate(text[step - 1 :: step]):
        i = k * step + step - 1
        if i >= at and c in _HEX:
            start = i
            while start > at and text[start - 1] in _HEX:
                start -= 1
            end = _HEX_RUN.match(text, i).end() if i < n else i
            if end - start >= step:
                yield start, end
            at = end


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, sorted."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_UPPER)
    found = [(a, 2, b) for a, b in _hex_runs(text)]
    free = {"assign": 0, "access": 0, "checked": 0}
    hits = sorted((end + 1 - size, kind, size) for end, (kind, size) in _automaton().iter(low))
    for start, kind, size in hits:
        if start < free[kind]:
            continue
        word = text[start : start + size]
        if kind == "assign":
            if word.isascii() and (m := _ASSIGN_TAIL.match(text, start + size)):
                free[kind] = m.end()
                if m.end(1) - m.start(1) >= _LEAST["assign"]:
                    found.append((start, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                free[kind] = m.end()
                if m.end() - start >= _LEAST["access"]:
                    found.append((start, 1, m.end()))
        elif word in _CHECKED and (m := _CHECKED_BODY.match(text, start + size)):
            body = m.group()
            if checksum(body[:30]) == body[30:]:
                free[kind] = m.end()
                found.append((start, KINDS.index(_CHECKED[word]), m.end()))
    return sorted(found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, a count per base kind, base_sha256, spans, and counts of added kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for text in batch.column(1):
                found = scan(text.as_py() or "")
                for k, column in enumerate(counts):
                    column.append(sum(1 for _, kind, _ in found if kind == k))
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found if k < len(BASE_KINDS))
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            arrays += [pa.array(c, pa.int64()) for c in counts[3:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_github", "n_npm"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_github long, n_npm long"
    return rows.mapInArrow(run, schema)
