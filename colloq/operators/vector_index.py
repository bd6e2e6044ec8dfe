"""Exact nearest neighbours by cosine for batches of query vectors, from lists around centroids.

Centroids are fitted on a bounded sample; every row is put on the list of its nearest one, with its
distance to it. A query first reads its own list. Its k-th best distance so far and the triangle
inequality then say which lists, and which rows of them, may hold something nearer; all of those are read.
Distances are those of unit vectors, whose order is that of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows that centroids are fitted on, centroids, and queries that are searched at a time, at most.
SAMPLE, LISTS, BLOCK = 20_000, 64, 1024
_SLACK = 1e-7


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of both."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def fit(sample: np.ndarray, lists: int = LISTS, rounds: int = 10) -> np.ndarray:
    """Centroids of unit vectors by Lloyd's rounds from evenly chosen rows."""
    centers = np.unique(sample, axis=0)
    centers = centers[np.linspace(0, len(centers) - 1, min(lists, len(centers))).astype(int)]
    for _ in range(rounds):
        near = _apart(sample, centers).argmin(1)
        for c in np.unique(near):
            centers[c] = sample[near == c].mean(0)
    return centers


def usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, vec (doubles): rows whose vector has a direction: no null, nothing that is not finite, not all zero."""
    held = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return held.filter(F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))


@dataclass
class Lists:
    """rows(id, vec, list, far), the centroids, and each list's largest distance and number of rows."""

    rows: DataFrame
    centers: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def build(rows: DataFrame, id_: str, vector: str, lists: int = LISTS, sample: int = SAMPLE) -> Lists:
    """The index of all usable rows; the sample is the ``sample`` rows of the smallest id hashes, at most."""
    held = usable(rows, id_, vector)
    n = held.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(min(1.0, 2 * sample / max(n, 1)) * (1 << 20)) + 1)
    drawn = held.filter(share).orderBy(F.xxhash64("id"), "id", "vec").limit(sample).select("vec").toArrow()
    if not drawn.num_rows:
        return Lists(held.withColumn("list", F.lit(0)).withColumn("far", F.lit(0.0)), np.zeros((0, 1)), np.zeros(0), np.zeros(0, int))
    centers = fit(_unit(drawn.column("vec").combine_chunks()), lists)
    shared = held.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _apart(_unit(batch.column(1)), shared.value)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["id", "vec", "list", "far"])

    placed = held.mapInArrow(assign, "id long, vec array<double>, list int, far double")
    # Lists in order: files' statistics leave out lists that are not asked, and a large list has many files.
    placed = written(placed.repartitionByRange("list", "id").sortWithinPartitions("list"), "lists")
    radius, sizes = np.zeros(len(centers)), np.zeros(len(centers), int)
    for r in placed.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each list
        radius[r.list], sizes[r.list] = r.far, r.n
    return Lists(placed, centers, radius, sizes)


def _read(index: Lists, asked: dict[int, np.ndarray], units: np.ndarray, ids: list[int], worst: np.ndarray, k: int) -> DataFrame:
    """query_id, id, score: the best k of each task for the queries (numbers) that ask each list."""
    from_center = _apart(units, index.centers)
    shared = index.rows.sparkSession.sparkContext.broadcast((asked, units, ids, worst, from_center))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, units, ids, worst, from_center = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x, own, far = _unit(batch.column(1)) if batch.num_rows else None, batch.column(2).to_numpy(), batch.column(3).to_numpy()
            row_ids = batch.column(0).to_numpy()
            for lst in np.unique(own).tolist():
                at = np.flatnonzero(own == lst)
                for q in asked.get(lst, ()):
                    # No row can be nearer than the difference of both distances to the centroid.
                    some = at[np.abs(from_center[q, lst] - far[at]) <= worst[q] + _SLACK]
                    if len(some):
                        score, rows = x[some] @ units[q], row_ids[some]
                        if q in best:
                            score, rows = np.concatenate((best[q][0], score)), np.concatenate((best[q][1], rows))
                        order = np.lexsort((rows, -score))[:k]
                        best[q] = score[order], rows[order]
        for q, (score, rows) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(rows), pa.int64()), pa.array(rows), pa.array(score)], ["query_id", "id", "score"])

    lists = [int(x) for x in asked]
    return index.rows.filter(F.col("list").isin(lists)).mapInArrow(search, "query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: Lists, queries: DataFrame, id_: str, vector: str, k: int, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """query_id, id, score (cosine), rank: the k nearest rows of every usable query, ties to the smaller id.

    Query ids are unique. Queries are searched in blocks, by a hash of their id, of about ``block``. ``report`` gets, for
    each block, the share of (query, list) pairs that were read.
    """
    asked = usable(queries, id_, vector)
    parts = max(1, -(-asked.count() // block))
    out = None
    for p in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).orderBy("id").toArrow()
        if not rows.num_rows or not len(index.centers):
            continue
        ids, units = rows.column("id").to_pylist(), _unit(rows.column("vec").combine_chunks())
        d = _apart(units, index.centers)
        # Enough lists, the nearest first, to hold k rows.
        order = d.argsort(1)
        enough = (index.sizes[order].cumsum(1) < k).sum(1)
        first = {(q, int(order[q, j])) for q in range(len(ids)) for j in range(min(enough[q] + 1, order.shape[1]))}
        by_list = lambda pairs: {lst: np.array(sorted(q for q, x in pairs if x == lst)) for lst in {x for _, x in pairs}}
        worst = np.full(len(ids), np.inf)
        near = written(_ranked(_read(index, by_list(first), units, ids, worst, k), k), "near")
        number = {q: i for i, q in enumerate(ids)}
        for r in near.filter(F.col("rank") == k).select("query_id", "score").collect():  # a row for each query
            worst[number[r.query_id]] = np.sqrt(max(0.0, 2 - 2 * r.score))
        may = {(int(q), int(x)) for q, x in zip(*np.nonzero(d - index.radius[None] <= worst[:, None] + _SLACK), strict=True) if index.sizes[x]}
        rest = may - first
        if report is not None:
            report.append(len(first | rest) / (len(ids) * max(1, int((index.sizes > 0).sum()))))
        found = near.drop("rank")
        if rest:
            found = found.unionByName(_read(index, by_list(rest), units, ids, worst, k))
        best = written(_ranked(found, k), "best")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return asked.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    return out
