"""Operators 5 and 9 and the pipeline against brute force."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from colloq.llm import common, components, language, packing, pii, simhash, topk, toxicity

from llm_frames import docs_frame


def plain_fingerprint(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, ids):
    fps, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_near_duplicates(odd_docs, empty_docs):
    docs = odd_docs.collect()
    found = {r.doc_id: r for r in simhash.near_duplicates(odd_docs).collect()}
    fps = [plain_fingerprint(d.text) for d in docs]
    want = plain_components(fps, [d.doc_id for d in docs])
    assert len(found) == len(docs)
    for d, fp, c in zip(docs, fps, want, strict=True):
        assert (found[d.doc_id].fingerprint, found[d.doc_id].component_id) == (f"{fp:016x}", c)
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(k))
    sets = [[set() for _ in a], [set() for _ in a]]
    for x, own in zip((a, b), sets, strict=True):
        for row, key in zip(*map(np.ndarray.tolist, simhash.keys_of(x)), strict=True):
            own[row].add(key)
    assert all(p & q for p, q in zip(*sets, strict=True))


@pytest.mark.parametrize("group", [8192, 16])
def test_dense_groups_in_blocks(spark, monkeypatch, group):
    """A large group of near copies gives the same components however it is split."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    rng = np.random.default_rng(3)
    fps = [0x0123456789ABCDEF]
    for _ in range(150):
        x = fps[rng.integers(0, len(fps))]
        for k in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(k)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components.connected(simhash.links(nodes)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = plain_components(fps, list(range(len(fps))))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components.connected(edges).collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_keep_one(spark):
    text = "one two three four five six seven"
    docs = docs_frame(spark, [text, "quite another text with other words in it", text, None, ""])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1, 3]
    assert simhash.keep_one(docs.union(docs)).count() == 3


def plain_top(rows, k=10):
    usable = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in usable:
        if q % 100 == 0:
            scored = sorted((-int(x @ y), i) for i, y in usable if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("n", [5, 700])
def test_topk(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(5001, None), (5002, [1.0, None] * 4), (5003, [float("nan")] * 8), (5004, []), (None, rows[0][1]), (5005, [float("inf")] * 8)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, label int")
    found = topk.search(frame, frame.filter("vec_id % 100 = 0")).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == plain_top(rows)
    assert topk.search(frame.limit(0), frame.limit(0)).count() == 0


def test_keep_one_of_nothing_and_of_null_ids(spark, empty_docs):
    assert simhash.keep_one(empty_docs).count() == 0
    text = "one two three four five six seven"
    docs = docs_frame(spark, [text, "quite another text with other words in it"]).selectExpr("cast(null as long) as doc_id", *docs_frame(spark, ["x"]).columns[1:])
    assert sorted(r.text for r in simhash.keep_one(docs.union(docs)).collect()) == sorted([text, "quite another text with other words in it"])


def test_topk_of_large_components(spark):
    """Whole numbers of any size; scores beyond 63 bits stand as the largest long."""
    big = [[2.0**30, 1.0], [2.0**30, 2.0], [3.0e6, -0.5], [1e-3, 5.5], [-(2.0**40), 1.0], [1e300, 1.0], [0.25, 0.125]]
    rows = [(100 * i, v) for i, v in enumerate(big)] + [(100, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(1024 * x) if abs(x) < 2.0**50 else int(x) * 1024 for x in v]) for i, v in rows]
    most = 2**63 - 1
    want = set()
    for q, x in ints:
        # Rows of one vec_id are one query: its best over both of its vectors.
        own = [y for i, y in ints if i == q]
        scored = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(y, z)))), i) for y in own for i, z in ints if i != q)[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    found = topk.search(frame, frame).collect()
    assert {tuple(r) for r in found} == want


def test_rows_of_one_vec_id_never_meet(spark):
    frame = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (7, [1.0]), (7, [1.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in topk.search(frame, frame).collect()} == {(0, 7), (7, 0)}


def test_pipeline_edges(spark, odd_docs, empty_docs, tmp_path):
    """Every stage on odd texts, repeated rows and nothing; extra columns stay."""
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, odd_docs.union(odd_docs), empty_docs):
        docs = corpus_pipeline.written(docs, "odd")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns, name
                assert out.exceptAll(docs).isEmpty() or name == "pii", name
                out.count()
        assert (out.count() == 0) == docs.isEmpty()


def test_pipeline_is_its_stages_by_brute_force(spark):
    """Each stage's decisions, made again one document at a time, give the same rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    weights = dict(zip(*(x.tolist() for x in toxicity.train(docs, labels))))
    bias = weights.get(1 << toxicity.BITS, 0.0)
    left = {d: t for d, t in rows.items() if 1 / (1 + math.exp(-bias - sum(weights.get(i, 0.0) for i in toxicity.features(t or "").tolist()))) < 0.3}
    frame = docs.filter(docs.doc_id.isin(*left))
    model = language.train(frame)
    for d in list(left):
        c = language.counts(left[d] or "")
        if not c.sum() or model.decode(language.vector(c)[None])[1][0] < language.AMBIGUOUS:
            del left[d]
    ids = sorted(left)
    roots = plain_components([plain_fingerprint(left[d]) for d in ids], ids)
    left = {d: left[d] for d, root in zip(ids, roots, strict=True) if d == root}
    found = pii.train(docs.filter(docs.doc_id.isin(*left)))
    for d, t in left.items():
        base = pii.base_spans(t or "")
        left[d] = t and pii.masked(t, base + pii.added_spans([t], [base], found)[0])
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = {}
    for d, t in left.items():
        ids = encode(t or "", add_special_tokens=False).ids + [2]
        want |= {(d, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())): None for k, (a, n) in enumerate(packing.cut_points(len(ids), 1024))}
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_pipeline_stages(spark):
    """Each stage works on what the one before kept; copies and toxic documents go, clean ones stay."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, now, sf), name)
        assert out.columns == columns
        before, after = now.count(), out.count()
        assert after == before if name == "pii" else 0.5 * before < after <= before
        now = out
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

    class Session:
        conf, sparkContext = spark.conf, Context

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(Session)
    assert common.shared_dir(spark)
