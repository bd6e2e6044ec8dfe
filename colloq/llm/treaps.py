"""Ranked lexical search over inverted treaps (operator 13).

The documents are read once: each gives its length and the counts of the asked terms, as a written
table. From it come the numbers of the corpus (N, L, df), and blocks of documents. A block is
turned into one treap per term: a search tree by doc_id, a heap by impact (the term's part of a
document's score), so a node's impact is the largest of its subtree.

An item is searched by walking the treaps of its terms together. An interval of documents stands
with the top node of each term in it; the sum of their impacts bounds every score in it, and an
interval whose bound is under the k-th best score so far is left out. From others the document of
the node with the largest impact is scored by searching it in all treaps, which also splits them
into those before and after it. Many intervals are split at a time, those with the highest bounds first. A task keeps
its best k of each item from block to block; the best of all tasks are ranked by two more shuffles.

Items are a query set: they are searched in parts of about ``QUERY_BYTES`` of text, each held by every task.

Defined results: a null or empty text has no terms and is no candidate; rows with equal or null
doc_ids are documents of their own (null last among equal scores); equal rows of items count once,
and different texts of one item_id are one item with all their terms; items without terms or
matches have no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
#: Text of items that is searched for at a time.
QUERY_BYTES = 4 << 20
#: Postings and documents of a block, at most (a single document may have more postings).
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 21, 1 << 16
#: Intervals split at a time, and cells (intervals times terms) in them; cells from which on the newest go first.
SPLIT, SPLIT_CELLS, MOST_CELLS = 1024, 1 << 18, 1 << 23

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_STEP = 1 << 20


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in lists: letters A-Z lowered, cut at all other ASCII but a-z and 0-9."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _STEP)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of the documents with a term: counts of the terms in ``number``; a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            keep, sizes, offsets, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                n, parts = 0, []
                for words in terms_of(text.as_py()):
                    n += len(words)
                    found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    parts.append(found[found >= 0])
                if n:
                    t, c = np.unique(np.concatenate(parts), return_counts=True)
                    keep.append(i)
                    sizes.append(n)
                    terms.append(t)
                    tfs.append(c.astype(np.int32))
                    offsets.append(offsets[-1] + len(t))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return written(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"), "counted")


class Treaps:
    """One treap per term over a block's postings; node P is none, with impact 0.

    term, doc, impact: postings by rising term, then document. Of equal impacts the earlier is above.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        p = len(term)
        self.doc, self.impact = np.append(doc, -1).astype(np.int32), np.append(impact, 0)
        own = np.append(term, -1)
        before = self._higher(own, np.append(impact, np.iinfo(np.int64).max), -1)
        after = self._higher(own, np.append(impact, np.iinfo(np.int64).max), 1)
        # A node hangs under the lower of its two nearest higher ones: to the right of the one before it, or to the left of the one after.
        left, right, root = (np.full(m, p, np.int32) for m in (p + 1, p + 1, n_terms))
        both = (before < p) & (after < p)
        right_of = (before < p) & ~(both & (self.impact[after] <= self.impact[before]))
        left_of = (after < p) & ~right_of
        i = np.arange(p, dtype=np.int32)
        right[before[right_of]] = i[right_of]
        left[after[left_of]] = i[left_of]
        top = ~(right_of | left_of)
        root[term[top]] = i[top]
        self.left, self.right, self.root, self.none = left, right, root, p

    @staticmethod
    def _higher(term: np.ndarray, impact: np.ndarray, step: int) -> np.ndarray:
        """The nearest node before (step -1) or after (1) in the same treap that stands above; P if there is none.

        All jump at once along what was found so far; what lies between is lower, so none is missed.
        """
        p = len(term) - 1
        at = np.arange(p) + step
        at[(at < 0) | (at >= p)] = p
        at[term[at] != term[:p]] = p
        at = np.append(at, p)
        todo = np.arange(p)
        while len(todo):
            seen = impact[at[todo]]
            todo = todo[seen < impact[todo] if step < 0 else seen <= impact[todo]]
            at[todo] = at[at[todo]]
        return at[:p]

    def down(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The top nodes strictly between low and high, under these nodes."""
        while True:
            there = node != self.none
            d = self.doc[node]
            late, early = there & (d >= high), there & (d <= low)
            if not (late | early).any():
                return node
            node = np.where(late, self.left[node], np.where(early, self.right[node], node))

    def split(self, node: np.ndarray, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Impacts in documents ``at``, and the top nodes of both sides: one search for ``at``."""
        shape, none = node.shape, self.none
        cur, hit = node.ravel(), np.zeros(node.size, np.int64)
        a, lo, hi = (np.broadcast_to(x, shape).ravel() for x in (at, low, high))
        first, second = np.full(node.size, none, np.int32), np.full(node.size, none, np.int32)
        todo = np.flatnonzero(cur != none)
        cur = cur[todo]
        while len(todo):
            d, want = self.doc[cur], a[todo]
            less, more = d < want, d > want
            x = todo[less]
            x, c = x[ok := (first[x] == none) & (d[less] > lo[x])], cur[less]
            first[x] = c[ok]
            x = todo[more]
            x, c = x[ok := (second[x] == none) & (d[more] < hi[x])], cur[more]
            second[x] = c[ok]
            same = ~(less | more)
            x, c = todo[same], cur[same]
            hit[x] = self.impact[c]
            first[x] = np.where(first[x] == none, self.left[c], first[x])
            second[x] = np.where(second[x] == none, self.right[c], second[x])
            cur = np.where(less, self.right[cur], self.left[cur])
            on = ~same & (cur != none)
            todo, cur = todo[on], cur[on]
        first, second = first.reshape(shape), second.reshape(shape)
        return hit.reshape(shape), self.down(first, low, at), self.down(second, at, high)


class Best:
    """The k best (score, document) so far, ties to the document first in order."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.doc_id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a score must reach to get in."""
        return max(1, int(self.score[-1])) if len(self.score) >= self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        some = score >= self.least
        score, null, doc_id = (np.concatenate(x) for x in ((self.score, score[some]), (self.null, null[some]), (self.doc_id, doc_id[some])))
        order = np.lexsort((doc_id, null, -score))[: self.k]
        self.score, self.null, self.doc_id = score[order], null[order], doc_id[order]


def walk(treaps: Treaps, terms: np.ndarray, times: np.ndarray, n_docs: int, best: Best, null: np.ndarray, doc_id: np.ndarray) -> int:
    """Bring the block's documents for an item into ``best``; returns how many were scored."""
    roots = treaps.root[terms]
    roots, times = roots[there := roots != treaps.none], times[there]
    if not len(roots):
        return 0
    bound = lambda v: (treaps.impact[v] * times).sum(1)
    most = max(1, min(SPLIT, SPLIT_CELLS // len(roots)))
    v = roots[None, :]
    pool, cells, scored = [(bound(v), np.full(1, -1, np.int32), np.full(1, n_docs, np.int32), v)], len(roots), 0
    while pool:
        newest = cells > MOST_CELLS
        b, low, high, v = pool.pop(-1 if newest else max(range(len(pool)), key=lambda i: pool[i][0][0]))
        cells -= v.size
        keep = b >= best.least
        b, low, high, v = b[keep], low[keep], high[keep], v[keep]
        if not len(b):
            continue
        top = (treaps.impact[v] * times).argmax(1)
        at = treaps.doc[v[np.arange(len(v)), top]]
        hit, first, second = treaps.split(v, low[:, None], at[:, None], high[:, None])
        best.add((hit * times).sum(1), null[at], doc_id[at])
        scored += len(at)
        v = np.concatenate((first, second))
        low, high = np.concatenate((low, at)), np.concatenate((at, high))
        b = bound(v)
        order = np.argsort(-b, kind="stable")
        order = order[b[order] >= best.least]
        for k in range(0, len(order), most):
            part = order[k : k + most]
            pool.append((b[part], low[part], high[part], v[part]))
            cells += v[part].size
    return scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in blocks of bounded postings and documents."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        ends = np.asarray(batch.column(2).offsets)
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(ends, ends[at] + BLOCK_POSTINGS - postings, "right")) - 1 - at
            take = min(batch.num_rows - at, max(room, 0 if held else 1), BLOCK_DOCS - docs)
            if take <= 0:
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
                continue
            held.append(batch.slice(at, take))
            docs, postings, at = docs + take, postings + int(ends[at + take] - ends[at]), at + take
    if held:
        yield pa.Table.from_batches(held)


def search_block(rows: pa.Table, weight: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], best: list[Best], n: int, total: int) -> None:
    """Search one block for all items (term numbers and how often each)."""
    ids = rows.column("doc_id").combine_chunks()
    null = np.asarray(ids.is_null())
    doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((doc_id, null))
    rows = rows.take(pa.array(order))
    null, doc_id = null[order], doc_id[order]
    m = 75 + 25 * rows.column("n").to_numpy() * n // total
    lists = rows.column("terms").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    term = lists.flatten().to_numpy(zero_copy_only=False)
    tf = rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
    impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    some = np.flatnonzero(impact)
    some = some[np.argsort(term[some], kind="stable")]
    treaps = Treaps(term[some], doc[some], impact[some], len(weight))
    for (terms, times), b in zip(items, best, strict=True):
        walk(treaps, terms, times, len(order), b, null, doc_id)


def _part(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task for these items (item_id, texts)."""
    asked = [(r.item_id, Counter(w for t in r.texts for ws in terms_of(t) for w in ws)) for r in rows]
    number = {t: i for i, t in enumerate(sorted({t for _, c in asked for t in c}))}
    found = counted(docs, number)
    n, total = found.agg(F.count("*"), F.sum("n")).first()
    weight = np.zeros(len(number), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each asked term
        weight[r.t] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    items = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in asked]
    shared = docs.sparkSession.sparkContext.broadcast((weight, items, [i for i, _ in asked], n, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items, item_ids, n, total = shared.value
        best = [Best(k) for _ in items]
        for block in _blocks(batches):
            search_block(block, weight, items, best, n, total)
        for item_id, b in zip(item_ids, best, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_id] * len(b.score), pa.int64()), pa.array(b.doc_id, pa.int64(), mask=b.null), pa.array(b.score)], ["item_id", "doc_id", "score"])

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of each item."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES))
    asked = asked.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    found = []
    for p in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).orderBy("item_id").collect()
        best = _part(docs, mine, k)
        found.append(best if parts == 1 else written(best, "best"))
    # k rows of each item and task: ranked in 16 groups of documents first.
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", *by).orderBy(*order))).filter(F.col("rank") <= k)
    dealt = reduce(DataFrame.unionByName, found).withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    return rank(rank(dealt, "deal").drop("rank", "deal")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def oracle(k: int = K) -> str:
    """The same rows in DuckDB SQL, by scoring every match."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as materialized (select row_number() over () as rid, doc_id, {terms} as terms from documents where text is not null),
c as (select count(*)::bigint as n, sum(len(terms))::bigint as l from d where len(terms) > 0),
q as (select item_id, term, count(*) as times from (select item_id, unnest({terms}) as term from (select distinct item_id, text from benchmark)) group by all),
p as materialized (select rid, doc_id, len(terms) as len, term, count(*) as tf from (select rid, doc_id, terms, unnest(terms) as term from d)
    where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by term, n),
s as (select item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l))))::bigint as score
    from q join p using (term) join w using (term), c group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= {k}
"""
