"""Operators 2, 4 and 10 against their libraries on whole texts."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from colloq.llm import bpe, packing, spaced_words, token_store


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_matches_library(odd_docs):
    encode, start = library("word_bpe_49k.json"), 0
    found = token_store.read_store(token_store.write_store(odd_docs, public_tokenizers.path("word_bpe_49k.json"))).collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for r in rows:
        ids = encode(r.text or "") + [2]
        assert tuple(by_id[r.doc_id]) == (r.doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_store_of_nothing(empty_docs):
    assert token_store.read_store(token_store.write_store(empty_docs, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 5000])
def test_codes_give_any_id_in_place(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 256, n), rng.integers(0, 1 << 20, n)).astype(np.uint32)
    dac = token_store.Dac(token_store.dac_encode(ids))
    assert len(dac) == n and (dac.all() == ids).all()
    assert [dac[i] for i in range(n)] == ids.tolist()


def test_codes_of_nothing():
    assert len(token_store.Dac(token_store.dac_encode(np.zeros(0, np.uint32)))) == 0


def test_bpe_matches_library_and_decodes(odd_docs, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3000)
    found = {r.doc_id: r for r in bpe.digests(odd_docs, path, public_tokenizers.PATTERN).collect()}
    rows = odd_docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = np.array(whole.encode_ordinary(r.text or ""), "<u4")
        want = (r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert tuple(found[r.doc_id]) == want


def test_single_tokens_from_the_files(spark, odd_docs, empty_docs, tmp_path, monkeypatch):
    """Kept files, opened again, give any id by rank; nothing is decoded as a whole."""
    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 500)
    encode, path = library("word_bpe_49k.json"), f"file://{tmp_path}/store"
    docs = odd_docs.filter("length(text) < 10000 or text is null").union(odd_docs.filter("doc_id = 5"))  # a repeated doc_id
    token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    store = token_store.open_store(spark, path)
    assert store.count() > 3
    rows = docs.filter("doc_id is not null").collect()
    wanted = {r.doc_id: [*encode(r.text or ""), 2] for r in rows}
    asked = [(d, k) for d, ids in wanted.items() for k in (0, len(ids) // 2, len(ids) - 1, len(ids), -1)] + [(None, 0), (10**9, 0), (1, None)]
    monkeypatch.setattr(token_store.Dac, "all", None)
    found = token_store.tokens_at(store, spark.createDataFrame(asked, "doc_id long, position long")).collect()
    want = {(d, k, wanted[d][k]) for d, k in asked if d in wanted and k is not None and 0 <= k < len(wanted[d])}
    assert {tuple(r) for r in found} == want
    assert len(found) == len(want) + len({w for w in want if w[0] == 5})
    assert token_store.tokens_at(store, spark.createDataFrame([], "doc_id long, position long")).count() == 0
    one = spark.createDataFrame([(40, 0), (150, 0)], "doc_id long, position long")
    near = store.filter(token_store._between(one))
    assert 0 < near.count() < store.count() / 2 and "PushedFilters: [Or(" in near._jdf.queryExecution().executedPlan().toString()


def test_repeated_ids_are_documents_of_their_own(spark, odd_docs):
    twice = odd_docs.union(odd_docs)
    path = public_tokenizers.path("word_bpe_49k.json")
    once = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_store.read_store(token_store.write_store(odd_docs, path)).collect())
    both = token_store.read_store(token_store.write_store(twice, path)).orderBy("start").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in both) == sorted(once + once)
    at = 0
    for r in both:
        assert r.start == at
        at += r.n_tokens
    pieces = packing.pack(twice, public_tokenizers.path("byte_bpe_50k.json"), capacity=128).collect()
    assert len(pieces) == 2 * packing.pack(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=128).count()
    places = {(r.sequence_id, r.offset) for r in pieces}
    assert len(places) == len(pieces)


def test_fuzz_of_spaced_words():
    rng = np.random.default_rng(8)
    parts = ["word", " word", "Word,", ".", "|", "!", "\n", "\n\n", " ", "  ", "\t", "é", " é.", "ß|", "'s", "日本", "Σ", "σ.\nΑΣ", "\u0301", "\x1c", "7", " 7,", "\r\n", "ǅ.", " ʼn!"]
    for kind, name in (("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")):
        encode, whole = spaced_words.memo(kind, public_tokenizers.path(name)).encode, library(name)
        for _ in range(4000):
            text = "".join(rng.choice(parts, rng.integers(1, 12)))
            assert np.frombuffer(encode(text), "<u2").tolist() == whole(text), repr(text)


def test_bpe_decodes(spark, odd_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(odd_docs, path, public_tokenizers.PATTERN), path).collect()
    assert {r.doc_id: bytes(r.text_bytes).decode() for r in decoded} == {r.doc_id: r.text or "" for r in odd_docs.collect()}


def test_bpe_stops_when_a_block_reads_differently(spark):
    """Equal numbers of words in another order must not pass for the same block."""

    def shuffled(batches):
        import random

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = text.split(" ")
                random.SystemRandom().shuffle(words)
                out.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "text"])

    docs = spark.createDataFrame([(i, " ".join(f" w{i}x{j}" for j in range(200))) for i in range(5)], "doc_id long, text string")
    docs = docs.mapInArrow(shuffled, "doc_id long, text string")
    with pytest.raises(Exception, match="must be replayable"):
        bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()


def test_bpe_of_nothing(empty_docs):
    assert bpe.digests(empty_docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def assert_packed(rows, docs, capacity):
    encode = library("byte_bpe_50k.json")
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {d.doc_id for d in docs}
    for d in docs:
        ids, own = encode(d.text or "") + [2], sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [(r.start, r.length) for r in own] == packing.cut_points(len(ids), capacity)
        assert [r.ids_crc32 for r in own] == [crc(ids[r.start : r.start + r.length]) for r in own]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("group", [50_000, 40])
def test_packing(odd_docs, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    rows = packing.pack(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=128).collect()
    bins = assert_packed(rows, odd_docs.collect(), 128)
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(lengths, 128) <= bins <= 1.05 * packing.lower_bound(lengths, 128) + 5


def test_rounds_keep_the_better_packing(spark, monkeypatch):
    """Groups above their bound exchange pieces; no round makes it worse, whatever the lengths."""
    rng = np.random.default_rng(5)
    lengths = rng.choice([30, 34, 45, 51, 60], 4000).tolist()
    # One file, so that every run deals the pieces alike: a run that starts from other groups may end with other counts.
    frame = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES_SCHEMA).coalesce(1)
    monkeypatch.setattr(packing, "pieces", lambda *a: frame)
    best = {}
    for group, least in ((100_000, 0.001), (250, 2.0), (250, 0.0)):
        monkeypatch.setattr(packing, "GROUP_PIECES", group)
        monkeypatch.setattr(packing, "LEAST_SAVED", least)
        rows = packing.pack(frame, "", capacity=100).collect()
        assert sorted(r.length for r in rows) == sorted(lengths) and len({r.doc_id for r in rows}) == 4000
        used = {}
        for r in rows:
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        assert max(used.values()) <= 100
        best[group, least] = len(used)
    assert packing.lower_bound(np.array(lengths), 100) <= best[250, 0.0] <= best[250, 2.0]
    assert packing.bound_of({30: 5, 60: 7}, 100) == packing.lower_bound(np.array([30] * 5 + [60] * 7), 100)


def test_packing_of_nothing(empty_docs):
    assert packing.pack(empty_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_lower_bound_holds_and_is_sharp():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 80))
        where, offset = packing.best_fit_decreasing(lengths, 100)
        used = np.bincount(where, lengths)
        assert used.max() <= 100 and packing.lower_bound(lengths, 100) <= len(used)
    assert packing.lower_bound(np.array([60] * 5), 100) == 5
    assert packing.lower_bound(np.array([34] * 4), 100) == 2


SPECIAL = ["end of page <|endoftext|> next", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>  c", "<|ENDOFTEXT|> é", "İ <|endoftext|>\n x", "<|endoftext", "no token"]


def test_added_tokens_as_the_library_has_them(spark):
    """The library as it is loaded, without any flag set."""
    from llm_frames import docs_frame
    from tokenizers import Tokenizer

    docs = docs_frame(spark, SPECIAL)
    words, letters = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))
    start = 0
    for r in sorted(token_store.read_store(token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"))).collect()):
        ids = words.encode(SPECIAL[r.doc_id], add_special_tokens=False).ids + [2]
        assert tuple(r) == (r.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    found = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    ids = [letters.encode(x, add_special_tokens=False).ids + [2] for x in SPECIAL]
    assert ids[1] == [50256, 2] and found == {k: (len(x), crc(x)) for k, x in enumerate(ids)}


def test_sequence_numbers_of_many_rounds_differ():
    most = (packing.MOST_ROUNDS << packing._GROUP_BITS + packing._BIN_BITS) + (((1 << packing._GROUP_BITS) - 1) << packing._BIN_BITS) + packing.GROUP_PIECES
    assert most < 1 << 63 and packing.GROUP_PIECES < 1 << packing._BIN_BITS
