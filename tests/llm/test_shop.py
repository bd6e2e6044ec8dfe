"""Operators 11, 12 and 13 against brute force, on odd rows."""

import collections
import datetime
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloq.llm import golden, sharding, treaps

from llm_frames import docs_frame


def test_shards_of_odd_documents(odd_docs, empty_docs):
    rows = sharding.shard(odd_docs.union(odd_docs.limit(3))).collect()
    texts = {d.doc_id: d.text or "" for d in odd_docs.collect()}
    assert len(rows) == len(texts) + 3
    by, of_text = collections.defaultdict(list), {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert of_text.setdefault(data, r.shard) == r.shard and 0 <= r.shard < 24
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(empty_docs).count() == 0


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 0, 0
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("n,shards,cell_bits", [(2, 5, 12), (40, 7, 2), (700, 24, 3), (700, 1, 3), (3000, 9, 5)])
def test_capacity_is_minimax(spark, monkeypatch, n, shards, cell_bits):
    """However coarse the first cells, the capacity is that of the search over all groups, and no shard is above it."""
    monkeypatch.setattr(sharding, "CELL_BITS", cell_bits)
    rng = random.Random(n)
    groups = sorted((rng.randrange(1 << 60), rng.randint(8, 900)) for _ in range(n))
    cuts = sharding.minimax(spark.createDataFrame(groups, "place long, size long"), shards)
    total, left, alone = sum(s for _, s in groups), shards, []
    for s, p in sorted(((s, -p) for p, s in groups), reverse=True):
        if left > 1 and s * left >= total:
            total, left = total - s, left - 1
            alone.append(-p)
    assert cuts.alone == alone
    rest = [s for p, s in groups if p not in alone]
    want = max(([least_capacity(rest, left)] if rest else []) + [s for p, s in groups if p in alone])
    held = collections.Counter()
    for r in spark.createDataFrame(groups, "place long, size long").withColumn("shard", cuts.shard("place")).collect():
        held[r.shard] += r.size
    assert max(held.values()) == cuts.capacity == want and max(held) < shards


def test_one_large_group_and_written_shards(spark, tmp_path):
    texts = ["copied text"] * 400 + [f"text number {i}" * (i % 7 + 1) for i in range(300)]
    docs = docs_frame(spark, texts).withColumn("shard", F.lit("theirs"))
    rows = sharding.shard(docs, 6).collect()
    alone = {r.shard for r in rows if texts[r.doc_id] == "copied text"}
    assert len(alone) == 1 and sum(r.shard in alone for r in rows) == 400
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    rest = [v for k, v in sizes.items() if k not in alone]
    assert len(rest) == 5 and max(rest) - min(rest) <= 2 * max(len(t) + 8 for t in texts)
    sharding.write_shards(docs, str(tmp_path / "out"), 6, files=2)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "shard").collect()
    assert {(r.doc_id, r.shard) for r in back} == {(r.doc_id, r.shard) for r in rows} and all(texts[r.doc_id] == r.text for r in back)


CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, stale int"


def plain_golden(rows):
    blank = lambda s: None if s is None or not s.strip(" \t\n\v\f\r") else s
    clusters = collections.defaultdict(list)
    for r in rows:
        clusters[r[0] if r[1] is None else r[1]].append(r)
    out = {}
    micros = lambda t: (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    for c, rs in clusters.items():
        last = max((micros(r[3]) for r in rs if r[3]), default=None)
        trust = lambda r: golden.TRUST.index(r[2]) if r[2] in golden.TRUST else 4
        stale = lambda r: r[3] is None or last - micros(r[3]) > 30 * 24 * 3_600_000_000
        recent = lambda r: (r[3] is None, -micros(r[3]) if r[3] else 0, trust(r), r[0] is None, r[0] or 0)
        trusted = lambda r: (stale(r), trust(r), *recent(r))

        def pick(key, value):
            found = [(key(r), value(r), r[0]) for r in rs if value(r) is not None]
            return min(found)[1:] if found else (None, None)

        cents = lambda r: math.floor(100 * r[9] + 0.5) if r[9] is not None and math.isfinite(r[9]) else None
        name = pick(lambda r: (-len(r[4]), *trusted(r)), lambda r: blank(r[4]))
        segment = pick(recent, lambda r: blank(r[8]))
        mail = pick(trusted, lambda r: blank(r[5]))
        paid = pick(lambda r: (segment[0] is None or blank(r[8]) != segment[0], *recent(r)), cents)
        at = min(rs, key=lambda r: ((blank(r[6]) is None) + (r[7] is None), *trusted(r)))
        placed = at[0] if blank(at[6]) is not None or at[7] is not None else None
        out[c] = (c, len(rs), sum(map(stale, rs)), name[0], mail[0], segment[0], blank(at[6]), at[7], paid[0], name[1], mail[1], segment[1], paid[1], placed)
    return out


@pytest.mark.parametrize("hot", [golden.HOT, 3])
def test_golden_records(spark, monkeypatch, hot):
    monkeypatch.setattr(golden, "HOT", hot)
    rng, t0 = random.Random(4), datetime.datetime(2024, 3, 31, 1, 30)
    strings = lambda xs: rng.choice([None, "", " \t", *xs])
    times = [None, t0, t0 - datetime.timedelta(days=30), t0 - datetime.timedelta(days=30, microseconds=1), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    rows = []
    for i in range(-200, 400):
        master = rng.choice([None, 7, 7, rng.randint(-50, 50)])
        rows.append((i, master, strings(["partner", "web", "crm", "store", " web"]), rng.choice([*times, t0 - datetime.timedelta(hours=rng.randint(0, 2000))]),
                     strings(["é", "long name", "漢字漢字", " x"]), strings([f"m{i % 3}"]), strings(["c", "d"]), rng.choice([None, 0, 5]),
                     strings(["retail", "public"]), rng.choice([None, math.nan, math.inf, -0.005, 12.345, -7.5, 1e9]), 1))
    rows += [(None, None, "web", t0, "n", None, "c", 1, "s", 1.0, 1), (None, 9000, None, None, None, None, None, None, None, None, 1)]
    for zone in ("UTC", "Europe/Athens"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = {r.cluster_id: tuple(r) for r in golden.golden(spark.createDataFrame(rows, CLIENTS)).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert found == plain_golden(rows)
    twice = spark.createDataFrame(rows, CLIENTS)
    doubled = golden.golden(twice.union(twice)).collect()
    assert {r.cluster_id: (r.n_records, r.name, r.balance_from) for r in doubled} == {c: (2 * r[1], r[3], r[12]) for c, r in plain_golden(rows).items()}
    assert golden.golden(spark.createDataFrame([], CLIENTS)).count() == 0


def test_keys_are_in_order(spark):
    longs = [-(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    found = spark.createDataFrame([(x,) for x in longs], "x long").selectExpr("x", f"unhex({golden._ordered('x')}) as b").collect()
    assert [bytes(r.b) for r in found] == sorted(bytes(r.b) for r in found) and len({bytes(r.b) for r in found}) == len(longs)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [(d, collections.Counter(w)) for d, t in docs if (w := TERM.findall(lower(t)))]
    n, total = len(words), sum(c.total() for _, c in words)
    df = collections.Counter(t for _, c in words for t in c)
    out = []
    for item in sorted({i for i, _ in items}, key=str):
        asked = collections.Counter(t for text in {t for i, t in items if i == item} for t in TERM.findall(lower(text)))
        scored = []
        for d, c in words:
            m = 75 + 25 * c.total() * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("docs_each,split,most,query_bytes", [(1 << 16, 1024, 1 << 23, 4 << 20), (7, 2, 8, 20)])
def test_search_by_treaps(spark, odd_docs, empty_docs, monkeypatch, docs_each, split, most, query_bytes):
    """Blocks, the number of intervals at a time, and parts of the items do not matter."""
    monkeypatch.setattr(treaps, "QUERY_BYTES", query_bytes)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    odd += [(0, "password tie"), (None, "tie"), (5000, "tie"), (5001, "tie"), (5001, "tie"), (5002, "İ ﬁ ÀÉ a"), (5003, "x" * 3_000_000 + " tie " * 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    items = [(1, "tie"), (2, "a b AB same same text"), (2, "a b AB same same text"), (3, None), (4, "..."), (5, "İ é 1"), (5, "words and"), (None, "text"), (7, "none such zzzz")]
    rows = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    want = plain_search(odd, [(i, t) for i, t in items if t is not None], 20)
    found = treaps.search(docs, rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert treaps.search(empty_docs, rows).count() == 0 and treaps.search(docs, rows.limit(0)).count() == 0


def test_treaps_hold_their_order_and_walks_skip(monkeypatch):
    rng = np.random.default_rng(2)
    n_docs, n_terms = 4000, 12
    term = np.sort(rng.integers(0, n_terms, 20000))
    pairs = np.unique(np.stack([term, rng.integers(0, n_docs, 20000)]), axis=1)
    term, doc = pairs
    impact = rng.integers(1, 60, len(term)) ** 3
    t = treaps.Treaps(term, doc, impact, n_terms + 1)
    seen = np.zeros(len(term), int)
    for k in range(n_terms + 1):
        todo = [(t.root[k], -1, n_docs)]
        while todo:
            v, low, high = todo.pop()
            if v == t.none:
                continue
            assert term[v] == k and low < doc[v] < high
            seen[v] += 1
            for child, a, b in ((t.left[v], low, doc[v]), (t.right[v], doc[v], high)):
                assert child == t.none or impact[child] <= impact[v]
                todo.append((child, a, b))
    assert (seen == 1).all()
    monkeypatch.setattr(treaps, "SPLIT", 16)
    times = np.array([1, 2, 1, 3])
    total = np.zeros(n_docs, np.int64)
    for k, q in zip((0, 3, 4, 9), times, strict=True):
        total[doc[term == k]] += q * impact[term == k]
    best = treaps.Best(10)
    scored = treaps.walk(t, np.array([0, 3, 4, 9]), times, n_docs, best, np.zeros(n_docs, bool), np.arange(n_docs))
    order = np.lexsort((np.arange(n_docs), -total))[:10]
    assert best.doc_id.tolist() == order.tolist() and best.score.tolist() == total[order].tolist()
    assert scored < (total > 0).sum() / 2


def test_blocks_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(treaps, "BLOCK_POSTINGS", 10)
    monkeypatch.setattr(treaps, "BLOCK_DOCS", 4)
    lists = [[1] * k for k in (3, 3, 3, 30, 0, 0, 0, 0, 0, 9, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array([1] * 11), pa.array(lists), pa.array(lists)], ["doc_id", "n", "terms", "tfs"])
    blocks = list(treaps._blocks(iter([batch, batch.slice(3, 5)])))
    assert [d for b in blocks for d in b.column("doc_id").to_pylist()] == [*range(11), *range(3, 8)]
    for b in blocks:
        sizes = [len(x) for x in b.column("terms").to_pylist()]
        assert len(sizes) <= 4 and (sum(sizes) <= 10 or len(sizes) == 1)
