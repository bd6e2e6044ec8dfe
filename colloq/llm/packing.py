"""Best-fit packing with certified partitions (operator 10).

Every document becomes token ids plus the end id. A document longer than the sequence length is
cut into full pieces, the odd piece first; full pieces are sequences of their own. The other
pieces are packed per bounded group by best-fit decreasing, and each group's bin count is held
against lower bounds from dual feasible functions. Groups above their bound give up the pieces
of all bins that are not full; these are dealt anew over fewer, full groups, and packed again,
until the bound certifies the count or no round saves a sequence.

Defined results: a null or empty text is the end id alone; repeated rows and null doc_ids are
documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spaced_words
from .common import written

#: Pieces that one group packs at once: bounded memory, and enough small pieces to fill gaps.
GROUP_PIECES = 50_000
#: Share of its sequences that a round of exchange must save for another one to follow.
LEAST_SAVED = 0.001

PIECES_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what full pieces leave over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, memo_words: int = spaced_words.MEMO_WORDS) -> DataFrame:
    """One row per piece of every document; a worker remembers the ids of ``memo_words`` spaced words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = spaced_words.memo("byte", vocabulary, memo_words).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode(text.as_py() or ""), "<u2").astype("<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(out, (doc_id, k, start, length, crc), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES_SCHEMA)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, each into the fullest bin that still takes it."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some open bin has, ascending
    bins = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = bisect.bisect_left(rooms, n)
        if k == len(rooms):
            b, room, bins = bins, capacity, bins + 1
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[k]
        where[i], offset[i] = b, capacity - room
        if left := room - n:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return where, offset


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound over two families of dual feasible functions.

    The first rounds pieces over capacity - e up to whole bins and drops those under e; the
    second divides into k + 1 parts, rounding down except at exact parts. Both map any set of
    pieces that fits one bin to a total of at most one bin.
    """
    return _bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(counts: dict[int, int], capacity: int) -> int:
    """``lower_bound`` of a number of pieces for each length."""
    count = np.zeros(capacity + 1, np.int64)
    count[list(counts)] = list(counts.values())
    return _bound(count, capacity)


def _bound(count: np.ndarray, capacity: int) -> int:
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        value = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
        best = max(best, -(-int((count * value).sum()) // capacity))
    for k in range(1, 101):
        parts = (k + 1) * x
        value = np.where(parts % capacity == 0, x * k, parts // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


#: Bits of a sequence's number for its place in the group and for the group; what is above is the round.
_BIN_BITS, _GROUP_BITS = 20, 30
MOST_ROUNDS = (1 << 63 - _BIN_BITS - _GROUP_BITS) - 1
_PACKED = PIECES_SCHEMA + ", bin long, offset long, room int, gap int"


def _pack_groups(rows: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    """Best-fit decreasing per group; ``gap`` is the group's bins beyond its lower bound."""

    def pack(found: pa.Table) -> pa.Table:
        found = found.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = found.column("length").to_numpy()
        group = found.column("grp")[0].as_py()
        where, offset = best_fit_decreasing(lengths, capacity)
        used = np.bincount(where, weights=lengths).astype(np.int64)
        gap = len(used) - lower_bound(lengths, capacity)
        name = (round_ << _GROUP_BITS + _BIN_BITS) + (group << _BIN_BITS) + where
        columns = {c: found.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        columns |= {"bin": pa.array(name), "offset": pa.array(offset)}
        columns |= {"room": pa.array((capacity - used[where]).astype(np.int32)), "gap": pa.array(np.full(len(where), gap, np.int32))}
        return pa.table(columns)

    # Row numbers of a written table come out the same when a lost task is run again.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups))
    return rows.withColumn("grp", salt).groupBy("grp").applyInArrow(pack, _PACKED)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, memo_words: int = spaced_words.MEMO_WORDS) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``memo_words`` is smaller where other operators share the workers' memory.
    """
    cut = written(pieces(docs, vocabulary, end_id, capacity, memo_words), "pieces")
    full = cut.filter(F.col("length") == capacity).select(
        "*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = cut.filter(F.col("length") < capacity)
    done: list[DataFrame] = []
    replaced, kept, round_ = 0, None, 0
    while True:
        # At most ``capacity`` lengths come to the driver.
        lengths = rest.groupBy("length").agg(F.count("*").alias("n")).collect()
        n = sum(r.n for r in lengths)
        if not n:
            break
        # Pieces that were one group are dealt to two, for another chance.
        groups = max(1 if kept is None else min(2, n), -(-n // GROUP_PIECES))
        if kept is not None and replaced <= bound_of({r.length: r.n for r in lengths}, capacity):
            done.append(kept)  # no packing of these pieces takes fewer
            break
        packed = written(_pack_groups(rest, groups, round_, capacity), f"packed{round_}")
        open_ = (F.col("gap") > 0) & (F.col("room") > 0)
        first = F.col("offset") == 0  # one piece of every sequence
        bins, left = packed.agg(F.count_if(first), F.count_if(first & open_)).first()
        if kept is not None and bins >= replaced:
            done.append(kept)
            break
        few = kept is not None and replaced - bins < LEAST_SAVED * replaced
        if not left or few or round_ == MOST_ROUNDS:
            done.append(packed)
            break
        done.append(packed.filter(~open_))
        kept = packed.filter(open_)
        rest, replaced, round_ = kept.select("doc_id", "piece", "start", "length", "ids_crc32"), left, round_ + 1
    out = full
    for p in done:
        out = out.unionByName(p.withColumnRenamed("bin", "sequence_id").drop("room", "gap"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
