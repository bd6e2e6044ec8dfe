"""Exact top-k inner-product search without random access (operator 5).

Vectors become integers, floor(1024 * x). Candidates are packed in blocks, each with one list per
component sorted by value; queries are packed in chunks, and every chunk meets every block once.
For a query, all lists of a block are read in step, from the end that its component's sign asks
for. A vector seen in some lists has a lower bound (the others at their lists' worst values) and
an upper bound (the others at the values the reading has reached). Reading stops when no vector
outside the k best lower bounds can still reach them, nor the k-th score of blocks read before;
only those that can get their final scores computed. Scores and ties (smaller vec_id) are exact.

Defined results: vectors that are null, empty or hold null or non-finite components take no part,
nor do null vec_ids; only vectors of one length meet; where a vector's integers are too large
for scores that doubles hold exactly, its scores are summed as whole numbers of any size, and
those beyond 63 bits stand as the largest (or smallest) long; rows that share a vec_id never meet each other, and are one query; with fewer than k candidates
all are returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
#: Vectors in a block of candidates; queries in a chunk.
BLOCK, CHUNK = 2048, 256
#: Shares of a block's lists that are read before bounds are looked at.
DEPTHS = (0.05, 0.15, 0.3, 0.5, 0.75, 1.0)
#: Sum of squares below which scores and their bounds are exact in doubles.
EXACT = 2.0**52
#: Blocks whose sorted lists a task keeps (about 2 MB each at 64 dimensions), the last met.
HELD = 16
#: Query chunks whose best scores a task remembers from block to block.
REMEMBERED = 4096


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length: block, dim, wide, ids, ints.

    Wide blocks hold vectors of squared length ``EXACT`` or more, as they came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, bool], tuple[list, list]] = {}

        def block(key: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal number
            ids, vectors = held.pop(key)
            number += 1
            ints = np.stack(vectors).astype("<f8") if key[1] else np.floor(np.stack(vectors) * SCALE).astype("<i4")
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([ints.tobytes()])],
                ["block", "dim", "wide", "ids", "ints"],
            )

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not len(v) or not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    floors = np.floor(v * SCALE)
                    key = len(v), not (np.abs(floors).max() < 2**31 and float(floors @ floors) < EXACT)
                ids, vectors = held.setdefault(key, ([], []))
                ids.append(vec_id)
                vectors.append(v)
                if len(ids) == size:
                    yield block(key)
        for key in list(held):
            yield block(key)

    usable = rows.filter("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    return usable.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "block long, dim int, wide boolean, ids binary, ints binary")


def whole(data: bytes, wide: bool, dim: int) -> list[list[int]]:
    """The integers of a block's vectors, whatever their size."""
    if not wide:
        return np.frombuffer(data, "<i4").reshape(-1, dim).tolist()
    # Doubles beyond 2**53 are whole numbers already.
    return [[math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE for x in v] for v in np.frombuffer(data, "<f8").reshape(-1, dim).tolist()]


def best_whole(ids: np.ndarray, vectors: list[list[int]], query_id: int, q: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, scores) of the k best, without bounds."""
    scored = sorted((-sum(map(operator.mul, v, q)), i) for i, v in zip(ids.tolist(), vectors, strict=True) if i != query_id)[:k]
    most = 2**63 - 1
    return np.array([i for _, i in scored], np.int64), np.array([max(-most - 1, min(most, -s)) for s, _ in scored], np.int64)


class Lists:
    """A block with its components' sorted lists."""

    def __init__(self, ids: bytes, ints: bytes, dim: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(ints, "<i4").reshape(-1, dim)
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(self.x, self.order, 0).astype(np.float64)

    def best(self, query_id: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the block's k best that reach ``floor``."""
        n, dim = self.x.shape
        other = self.ids != query_id
        up = q > 0
        q = q.astype(np.float64)
        worst = np.where(up, self.value[0], self.value[-1]) * q
        known = np.zeros(n)
        unseen = np.ones((n, dim), np.float32)
        columns = np.arange(dim)
        done, can = 0, other
        for share in DEPTHS:
            to = max(done + 1, int(n * share)) if share < 1 else n
            if to <= done:
                continue
            here = np.where(up, self.order[::-1][done:to], self.order[done:to])
            gain = np.where(up, self.value[::-1][done:to], self.value[done:to]) * q
            known += np.bincount(here.ravel(), gain.ravel(), n)
            unseen[here, columns] = 0
            frontier = gain[-1]
            upper = np.where(other, known + unseen @ frontier, -np.inf)
            lower = np.where(other, known + unseen @ worst, -np.inf)
            kth = np.partition(lower, n - k)[n - k] if n > k else -np.inf
            can = (upper >= max(kth, floor) - 0.5) & other
            done = to
            if can.sum() <= max(4 * k, n // 50):
                break
        found = np.flatnonzero(can)
        score = self.x[found].astype(np.int64) @ q.astype(np.int64)
        first = np.lexsort((self.ids[found], -score))[:k]
        first = first[score[first] >= floor]
        return self.ids[found[first]], score[first]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best among ``vectors``."""
    blocks = written(_packed(vectors, BLOCK), "blocks")
    chunks = _packed(queries, CHUNK)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Lists] = {}  # the blocks met last; the join may give blocks in any order
        reached: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                b, dim, wide, ids, ints, chunk, q_wide, q_ids, q_ints = (c[row].as_py() for c in batch.columns)
                q_ids = np.frombuffer(q_ids, "<i8")
                if wide or q_wide:
                    ids, vectors = np.frombuffer(ids, "<i8"), whole(ints, wide, dim)
                    for query, q in zip(q_ids.tolist(), whole(q_ints, q_wide, dim), strict=True):
                        found, score = best_whole(ids, vectors, query, q, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query, np.int64)), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])
                    continue
                lists = held.pop(b, None) or Lists(ids, ints, dim)
                held[b] = lists
                if len(held) > HELD:
                    del held[next(iter(held))]
                q_ints = np.frombuffer(q_ints, "<i4").reshape(-1, dim)
                tops = reached.get(chunk)
                if tops is None:
                    tops = np.full((len(q_ids), k), -np.inf)
                out: list[list[np.ndarray]] = [[], [], []]
                for i, (query, q) in enumerate(zip(q_ids.tolist(), q_ints, strict=True)):
                    found, score = lists.best(query, q, k, tops[i, 0])
                    tops[i] = np.sort(np.concatenate((tops[i], score)))[-k:]
                    for column, value in zip(out, (np.full(len(found), query), found, score), strict=True):
                        column.append(value)
                if len(reached) < REMEMBERED:
                    reached[chunk] = tops
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["query_id", "vec_id", "score"])

    # Chunks are sent once to every group of blocks; a group is one join key. Few blocks make
    # groups of four, many make groups of 256, so copies of the queries stay a small share.
    n = blocks.count()
    groups = max(1, min(-(-n // 4), max(64, -(-n // 256))))
    left = blocks.select("block", "dim", "wide", "ids", "ints", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("grp"))
    right = chunks.select(F.col("block").alias("chunk"), F.col("dim").alias("q_dim"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))
    pairs = left.join(right, (left.grp == right.grp) & (left.dim == right.q_dim)).select("block", "dim", "wide", "ids", "ints", "chunk", "q_wide", "q_ids", "q_ints")
    near = pairs.mapInArrow(meet, "query_id long, vec_id long, score long")
    # A group holds up to k rows per block; the limit is applied before the shuffle too.
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, every: int = 100) -> str:
    return f"""
with e as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
    where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from e q join e c on q.vec_id % {every} = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {k}
"""
