"""Token ids in directly addressable codes (operator 2).

File format: a Parquet table of segments in ascending document order. A segment holds up to
``SEGMENT_TOKENS`` ids (more only for one longer document) of consecutive documents: the least and largest id that
is not null, their ids, their token offsets, and the ids as directly addressable codes. Level 0 holds the lowest 8 bits
of every id, level 1 the next 8 bits of those ids that need them, and so on. Each level has a
continuation bitmap (bit i: id i goes on in the next level) and a rank directory (ones before
each 512-bit block), so id i is found with one rank per level and nothing else is decoded.
``write_store`` with a path keeps the files, ``open_store`` opens them again, ``tokens_at`` reads
single ids and ``read_store`` every document. Segments stand in the order of doc_ids, so the statistics that
Parquet keeps of least and largest ids leave out all files and row groups that are not asked.

Defined results: a null or empty text is the end id alone; documents with equal or null doc_id
are kept, nulls first, equal ids by text hash; an empty table gives no rows; extra columns are
ignored. ``tokens_at`` gives one row for each different (doc_id, position) asked and document of
that id, none for positions outside the document or for null doc_ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spaced_words
from .common import partitions_for, written

SEGMENT_TOKENS = 1 << 20
CHUNK_BITS = 8
BLOCK_BITS = 512
#: Ranges of doc_ids that a lookup filters segments by, at most.
RANGES = 64
#: Input bytes for each range partition.
PARTITION_BYTES = 8 << 20

_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_encode(ids: np.ndarray) -> bytes:
    """Levels of 8-bit chunks with continuation bitmaps and rank directories."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        block = BLOCK_BITS // 8
        ones = _BYTE_ONES[np.pad(bits, (0, -len(bits) % block))].reshape(-1, block).sum(1, dtype=np.uint32)
        rank = np.concatenate(([0], np.cumsum(ones)))[:-1].astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<IIII", n, len(a), len(b), len(c)) for n, a, b, c in levels)
    return head + b"".join(a + b + c for _, a, b, c in levels)


class Dac:
    """A reader that addresses ids in place."""

    def __init__(self, data: bytes):
        (levels,), at = struct.unpack_from("<I", data), 4
        sizes = [struct.unpack_from("<IIII", data, at + 16 * k) for k in range(levels)]
        at += 16 * levels
        self.levels = []
        for n, a, b, c in sizes:
            chunk = np.frombuffer(data, np.uint8, a, at)
            bits = np.frombuffer(data, np.uint8, b, at + a)
            rank = np.frombuffer(data, "<u4", c // 4, at + a + b)
            self.levels.append((n, chunk, bits, rank))
            at += a + b + c

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        """Id i, by one rank in each level that it reaches."""
        value, shift = 0, 0
        for _, chunk, bits, rank in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            whole = bits[block * BLOCK_BITS // 8 : i >> 3]
            within = int(_BYTE_ONES[whole].sum()) + int(_BYTE_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i, shift = int(rank[block]) + within, shift + CHUNK_BITS
        return value

    def all(self) -> np.ndarray:
        """Every id, from the last level up."""
        out = np.zeros(0, np.uint32)
        for n, chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            if len(out):
                here[np.unpackbits(bits, count=n, bitorder="little").view(bool)] |= out << CHUNK_BITS
            out = here
        return out


SEGMENT_SCHEMA = "part int, before long, first_id long, last_id long, doc_ids array<long>, offsets array<long>, n_tokens long, codes binary"
_SEGMENT_TYPES = [
    ("part", pa.int32()), ("before", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("codes", pa.binary()),
]


def write_store(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode all documents and write the segments to ``path``; returns the files as read back.

    Without a path the files live in the shared folder until the interpreter ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = spaced_words.memo("word", vocabulary).encode, struct.pack("<H", end_id)
        part, before = TaskContext.get().partitionId(), 0
        ids: list = []
        codes: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(c) // 2 for c in codes])))
            data = dac_encode(np.frombuffer(b"".join(codes), "<u2"))
            there = [i for i in ids if i is not None] or [None]
            values = (part, before, there[0], there[-1], ids, offsets.tolist(), int(offsets[-1]), data)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, (_, t) in zip(values, _SEGMENT_TYPES, strict=True)], [n for n, _ in _SEGMENT_TYPES]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = encode(text.as_py() or "") + end
                if held and held + len(own) // 2 > SEGMENT_TOKENS:
                    yield segment()
                    ids, codes, held, before = [], [], 0, before + held
                ids.append(doc_id.as_py())
                codes.append(own)
                held += len(own) // 2
        if ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions_for(docs, PARTITION_BYTES)
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(run, SEGMENT_SCHEMA), "tokens", path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The segments that ``write_store`` left at ``path``."""
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def _between(asked: DataFrame) -> Column:
    """Whether a segment may hold an asked doc_id: within one of at most ``RANGES`` ranges, which have gaps between them."""
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = asked.agg(F.percentile_approx("doc_id", shares, 100 * RANGES)).first()[0] or []
    held = F.array(*(F.lit(c) for c in sorted({*cuts}))).cast("array<bigint>")
    ranges = asked.groupBy(F.size(F.filter(held, lambda c: c <= F.col("doc_id"))).alias("r")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    found = F.lit(False)
    for r in ranges.collect():
        found = found | ((F.col("first_id") <= r.high) & (F.col("last_id") >= r.low))
    return found


def tokens_at(store: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, position, token for the (doc_id, position) rows asked, by rank alone.

    The ids asked are put into at most ``RANGES`` ranges, which the scan is filtered by. The document lists of what
    is left lead to a segment and a place in it; only segments that are asked give their codes, and no
    level is decoded as a whole. A segment's different places are one
    row, as many as it has ids at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, asked in zip(batch.column(0), batch.column(1), strict=True):
                dac, asked = Dac(codes.as_py()), asked.values.flatten()
                found = [dac[i] for i in asked[2].to_numpy().tolist()]
                yield pa.RecordBatch.from_arrays([asked[0], asked[1], pa.array(found, pa.int64())], ["doc_id", "position", "token"])

    asked = positions.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"))
    asked = asked.filter("doc_id is not null and position >= 0").distinct()
    asked = written(asked, "asked")
    near = store.filter(_between(asked))
    places = near.select("part", "before", "offsets", F.posexplode("doc_ids").alias("k", "doc_id"))
    places = places.select("part", "before", "doc_id", F.expr("offsets[k]").alias("at"), F.expr("offsets[k + 1] - offsets[k]").alias("n"))
    hits = places.join(asked, "doc_id").filter("position < n")
    per = hits.groupBy("part", "before").agg(F.collect_list(F.struct("doc_id", "position", (F.col("at") + F.col("position")).alias("i"))).alias("asked"))
    return near.select("part", "before", "codes").join(per, ["part", "before"]).select("codes", "asked").mapInArrow(run, "doc_id long, position long, token long")


def read_store(store: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base = batch.column(0)[row].as_py()
                ids = Dac(batch.column(3)[row].as_py()).all().astype("<u4")
                offsets = batch.column(2)[row].values.to_numpy()
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[row].values, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # A segment holds the tokens before it in its range partition; the totals of all partitions
    # (one row each, 65,536 at most: ``partitions_for``) give what came before the partition.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"))
    rows = store.join(F.broadcast(earlier), "part").select((F.col("before") + F.col("earlier")).alias("base"), "doc_ids", "offsets", "codes")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
