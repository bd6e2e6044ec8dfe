"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 9).

A fingerprint has one bit per position of 64, set if more than half of the XXH64 values (seed 42)
of the text's 3-word shingles have it set. Fingerprints with at most 3 differing bits are linked.

Candidates. The 64 bits are three segments of 21, 21 and 22 bits, padded to the 23 bits of the
perfect binary Golay code, which puts every word within 3 bits of exactly one of 4,096 codewords.
``near(s)`` are the codeword numbers of a segment and of all its one-bit changes (six at most), so
two segments with one differing bit share the codeword of either. Of 3 or fewer errors over
three segments, either some segment has none, and then one of the other two has at most one: keys
(segment j itself, near codewords of segment i), for all ordered pairs; or every segment has
exactly one: keys (near, near, own) and (own, own, near) of the three codewords. All pairs that
share a key are verified on the 64 bits, so links are exact.

Groups that share a key are compared inside a task; only the edges of a spanning forest leave it.
A group beyond ``GROUP`` members is compared in blocks over many tasks, with the same result.

Defined results: no words (null or empty text): fingerprint zero, linked like any other; one or
two words: one shingle; repeated rows share a fingerprint; documents with null doc_id keep their
component's smallest doc_id, null if it has none; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of, written
from .components import connected

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Members of a key's group that one task compares.
GROUP = 8192
#: Groups up to this size are compared pair by pair, larger ones by growing a forest.
PAIRWISE = 24

SEGMENTS = ((0, 21), (21, 21), (42, 22))
_GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _golay_errors() -> np.ndarray:
    """The error pattern of weight 0 to 3 for each of the 2,048 syndromes."""
    patterns = [sum(1 << i for i in c) for w in range(4) for c in combinations(range(23), w)]
    patterns = np.array(patterns, np.uint32)
    out = np.zeros(2048, np.uint32)
    out[_syndrome(patterns)] = patterns
    return out


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = rest ^ ((rest >> np.uint32(bit) & np.uint32(1)) * np.uint32(_GOLAY << (bit - 11)))
    return rest


_ERRORS: np.ndarray | None = None


def golay_index(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the codeword within 3 bits of each 23-bit word."""
    global _ERRORS
    if _ERRORS is None:
        _ERRORS = _golay_errors()
    words = words.astype(np.uint32)
    return (words ^ _ERRORS[_syndrome(words)]) >> np.uint32(11)


def _near(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(codeword numbers, mask of distinct ones): column 0 is the segment's own."""
    found = np.stack([golay_index(segment), *(golay_index(segment ^ np.uint32(1 << i)) for i in range(bits))], 1)
    own, rest = found[:, :1], np.sort(found[:, 1:], 1)
    keep = np.ones(found.shape, bool)
    keep[:, 1:] = rest != own
    keep[:, 2:] &= rest[:, 1:] != rest[:, :-1]
    return np.concatenate([own, rest], 1), keep


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fingerprints``, key): all keys of all fingerprints (uint64)."""
    segments = [(fingerprints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.uint32) for a, n in SEGMENTS]
    near = [_near(s, n) for s, (_, n) in zip(segments, SEGMENTS, strict=True)]
    rows, keys = [], []

    def add(table: int, index: np.ndarray, value: np.ndarray) -> None:
        rows.append(index)
        keys.append(value.astype(np.uint64) | np.uint64(table << 36))

    flat = [(*np.nonzero(keep), code) for code, keep in near]
    table = 0
    for i in range(3):
        at, column, code = flat[i]
        for j in range(3):
            if i != j:
                add(table, at, code[at, column].astype(np.uint64) << np.uint64(22) | segments[j][at].astype(np.uint64))
                table += 1
    own = [code[:, 0].astype(np.uint64) for code, _ in near]
    # (own, own, near)
    at, column, code = flat[2]
    add(table, at, own[0][at] << np.uint64(24) | own[1][at] << np.uint64(12) | code[at, column])
    # (near, near, own) but (own, own, own)
    both = near[0][1][:, :, None] & near[1][1][:, None, :]
    both[:, 0, 0] = False
    at, c0, c1 = np.nonzero(both)
    add(table, at, near[0][0][at, c0].astype(np.uint64) << np.uint64(24) | near[1][0][at, c1].astype(np.uint64) << np.uint64(12) | own[2][at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def flush(hashes: list[int], sizes: list[int]) -> np.ndarray:
        sizes_ = np.array(sizes, np.int64)
        out = np.zeros(len(sizes_), np.uint64)
        some = sizes_ > 0
        if some.any():
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = (np.cumsum(sizes_) - sizes_)[some]
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[some] = np.packbits(2 * ones > sizes_[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            hashes: list[int] = []
            sizes: list[int] = []
            out = []
            for text in batch.column(1):
                w = words_of((text.as_py() or ""), lower=True)
                if len(w) < SHINGLE:
                    own = [digest(b" ".join(w), SEED)] if w else []
                else:
                    own = [digest(x, SEED) for x in map(b" ".join, zip(w, w[1:], w[2:]))]
                hashes += own
                sizes.append(len(own))
                if len(hashes) > 40_000:
                    out.append(flush(hashes, sizes))
                    hashes, sizes = [], []
            out.append(flush(hashes, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _forest(members: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect exactly what links of at most MOST_BITS bits connect."""
    a, b = [], []
    rest = np.unique(members)
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            hit = np.bitwise_count(rest ^ one) <= MOST_BITS
            if hit.any():
                found = rest[hit]
                a.append(np.full(len(found), one))
                b.append(found)
                frontier.extend(found)
                rest = rest[~hit]
    return a, b


def _edges(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within groups of equal (sorted) keys."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lag in range(1, min(PAIRWISE, int(size.max())) if len(size) else 0):
        begin = first[(size > lag) & (size <= PAIRWISE)]
        if not len(begin):
            continue
        n = size[(size > lag) & (size <= PAIRWISE)] - lag
        i = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hit = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= MOST_BITS]
        a.append(fps[hit])
        b.append(fps[hit + lag])
    for k in np.flatnonzero(size > PAIRWISE):
        x, y = _forest(fps[first[k] : first[k] + size[k]])
        a += x
        b += y
    return np.concatenate(a), np.concatenate(b)


_EDGES = "a long, b long, more boolean"


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct ``fp`` of ``nodes``."""

    def explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(found), 2000):
                some = found[i : i + 2000]
                row, key = keys_of(some)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(some[row].view(np.int64))], ["key", "fp"])

    def batch_of(a: np.ndarray, b: np.ndarray, more: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), more))], ["a", "b", "more"]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, large = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy().view(np.uint64)))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            if large is not None:  # the rest of a group that goes to many tasks
                end = int(np.searchsorted(keys != large, True)) if keys[-1] != large else len(keys)
                yield batch_of(keys[:end], fps[:end], True)
                keys, fps = keys[end:], fps[end:]
                if not len(keys):
                    continue
                large = None
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if last:
                yield batch_of(*_edges(keys[:last], fps[:last]), False)
                keys, fps = keys[last:], fps[last:]
            if len(keys) > GROUP:
                large = keys[0]
                yield batch_of(keys, fps, True)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield batch_of(*_edges(keys, fps), False)

    def compare_blocks(found: pa.Table) -> pa.Table:
        a, b = _forest(found.column("fp").to_numpy().view(np.uint64))
        a = np.concatenate([np.zeros(0, np.uint64), *a])
        b = np.concatenate([np.zeros(0, np.uint64), *b])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    keyed = nodes.select("fp").mapInArrow(explode_keys, "key long, fp long")
    sorted_ = keyed.repartition("key").sortWithinPartitions("key")
    found = written(sorted_.mapInArrow(compare, _EDGES), "links")
    edges = found.filter("not more").select("a", "b")
    large = found.filter("more").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    sizes = large.groupBy("key").agg(F.count("*").alias("n"))
    if not sizes.isEmpty():
        # Members are dealt to blocks of about GROUP / 2; each pair of blocks is one task's group.
        blocks = large.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / (GROUP // 2)).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = blocks.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        edges = edges.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(compare_blocks, "a long, b long"))
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    marked = written(fingerprints(docs), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(links(nodes))
    known = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(known.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns as they are: the one with the smallest doc_id.

    Where doc_ids repeat or are null, rows are numbered as they are read, and the first stays;
    ``docs`` must then come from files, so that both readings number alike.
    """
    ids = docs.select(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if ids[0] == ids[2]:
        found = near_duplicates(docs)
        stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_stay"))
        return docs.join(stay, docs.doc_id == stay._stay, "left_semi")
    found = near_duplicates(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"))
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_stay"))
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(stay, numbered[row] == stay._stay, "left_semi").drop(row)
