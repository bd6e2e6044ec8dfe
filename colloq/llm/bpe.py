"""Byte-level BPE by a global shuffle of distinct words, and decoding (operator 4).

Texts are read in blocks. A block's words (spaced words, see ``spaced_words``) are exploded with
their positions; positions stay in the block as numbers of its distinct words, and only the
distinct words travel, to the partition of their hash, where each is encoded once as long as the
partition's memo (``MEMO_WORDS``) holds it, else again with the same result. The ids come back to
the block, are joined to its positions, and the documents are put together again. Decoding joins
ids with the table of token bytes: one row per rank, so its size is fixed by the vocabulary file,
and it is broadcast.

A word's hash decides its partition, so a frequent word costs one row per block, not one per
occurrence. Blocks and word lists travel as compressed batches.

Defined results: a null or empty text has no ids; null or repeated doc_ids are documents of
their own; an empty table gives no rows; extra columns are ignored. The input must give the same
rows in the same order when a task is read again (files do): a digest of each block's words in
their order travels with the words and with the positions, and an unequal one stops the job.
A vocabulary with an id of 65,536 or more is refused with ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for
from .spaced_words import cut

#: Characters of a block; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Input bytes for each partition, and word partitions at most: different words grow far slower
#: than texts, and a block sends one list to each word partition.
BUCKET_BYTES, WORD_BUCKETS = 16 << 20, 4096
#: Encoded words that a word partition remembers at once; more are encoded again.
MEMO_WORDS = 400_000

_SEPARATOR = "\x00"
_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The ranks of a vocabulary file, loaded once per worker."""
    if (path, pattern) not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values(), default=0) >= 1 << 16:
            raise ValueError(f"{path}: ids beyond 16 bits")
        _ENCODINGS[path, pattern] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table, by rank."""
    import base64

    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class _Words(dict):
    """Numbers for words, in order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[tuple[int, _Words, list]]:
    """(block, its distinct words, [(doc_id, word numbers)]) for the texts of one partition."""
    block, held = TaskContext.get().partitionId() << 32, 0
    words, docs = _Words(), []
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            if held and held + len(text) > BLOCK_CHARS:
                yield block, words, docs
                block, words, docs, held = block + 1, _Words(), [], 0
            parts = cut(text) if text else []
            if ids:
                docs.append((doc_id.as_py(), np.fromiter(map(words.__getitem__, parts), np.uint32, len(parts))))
            else:
                for w in parts:
                    words[w]
                docs.append(None)
            held += len(text)
    if docs:
        yield block, words, docs


def _pack_words(words: list[str]) -> bytes:
    """Length-free when no word holds the separator, which text hardly ever does."""
    data = _SEPARATOR.join(words)
    if data.count(_SEPARATOR) == len(words) - 1:
        return zstandard.compress(b"0" + data.encode("utf-8", "surrogatepass"), 3)
    parts = [w.encode("utf-8", "surrogatepass") for w in words]
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.compress(b"1" + head + b"".join(parts), 3)


def _unpack_words(data: bytes) -> list[str]:
    data = zstandard.decompress(data)
    if data[:1] == b"0":
        return data[1:].decode("utf-8", "surrogatepass").split(_SEPARATOR)
    n = int(np.frombuffer(data, "<u4", 1, 1)[0])
    sizes = np.frombuffer(data, "<u4", n, 5)
    ends = 5 + 4 * n + np.cumsum(sizes, dtype=np.int64)
    return [data[e - s : e].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _digest(words) -> int:
    """A signed 64-bit digest of words in their order."""
    data = _SEPARATOR.join(words).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def encode(docs: DataFrame, vocabulary: str, pattern: str, then=None, schema: str = "doc_id long, ids binary") -> DataFrame:
    """doc_id and ids (little-endian unsigned 16-bit integers) of every whole text.

    ``then`` maps the batches on in the same Python worker, to ``schema``: every chained
    mapInArrow would keep one more worker for each task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partitions = partitions_for(docs, BUCKET_BYTES)
    buckets = min(WORD_BUCKETS, partitions)

    def explode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, _ in _blocks(batches, ids=False):
            lists: list[list[str]] = [[] for _ in range(buckets)]
            for w in words:
                lists[_bucket_of(w, buckets)].append(w)
            found = [(b, _pack_words(x)) for b, x in enumerate(lists) if x]
            digest = _digest(w for x in lists for w in x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([digest] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())],
                ["bucket", "block", "digest", "words"],
            )

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary, pattern)
        known: dict[str, bytes] = {}

        def ids_of(word: str) -> bytes:
            ids = np.array(encoder.encode_ordinary(word), "<u2").tobytes()
            if len(known) < MEMO_WORDS:
                known[word] = ids
            return ids

        for batch in batches:
            out = []
            for data in batch.column(3):
                ids = [known.get(w) or ids_of(w) for w in _unpack_words(data.as_py())]
                sizes = np.array([len(x) // 2 for x in ids], "<u4")
                out.append(zstandard.compress(np.array([len(ids)], "<u4").tobytes() + sizes.tobytes() + b"".join(ids), 3))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["block", "bucket", "digest", "data"])

    def keep_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, found in _blocks(batches, ids=True):
            # Words are numbered anew: by bucket, then in the order in which they were sent.
            bucket = np.fromiter((_bucket_of(w, buckets) for w in words), np.int64, len(words))
            place, order = np.empty(len(words), np.uint32), np.argsort(bucket, kind="stable")
            place[order] = np.arange(len(words), dtype=np.uint32)
            names = list(words)
            digest = _digest(names[i] for i in order.tolist())
            places = [place[p] for _, p in found]
            sizes = np.array([len(p) for p in places], "<u4")
            flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
            planes = [(flat >> s & 0xFF).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]
            data = np.array([len(sizes), len(words)], "<u4").tobytes() + sizes.tobytes() + b"".join(planes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([digest], pa.int64()), pa.array([zstandard.compress(data, 6)], pa.binary()), pa.array([[d for d, _ in found]], pa.list_(pa.int64()))],
                ["block", "bucket", "digest", "data", "doc_ids"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the positions (bucket -1) before the block's words."""
        now, mark, doc_ids, positions, lists = None, 0, [], b"", []

        def block() -> Iterator[pa.RecordBatch]:
            n, distinct = np.frombuffer(positions, "<u4", 2).tolist()
            sizes = np.frombuffer(positions, "<u4", n, 8).astype(np.int64)
            planes = np.frombuffer(positions, np.uint8, offset=8 + 4 * n).reshape(4, -1)
            counts = [np.frombuffer(x, "<u4", int(np.frombuffer(x, "<u4", 1)[0]), 4) for x in lists]
            length = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
            if len(length) != distinct:
                raise RuntimeError("a block was read again with other words; the input must be replayable")
            ids = np.frombuffer(b"".join(x[4 + 4 * len(c) :] for x, c in zip(lists, counts, strict=True)), "<u2")
            begin = np.cumsum(length) - length
            at = 0
            for first in range(0, n, 256):
                some = sizes[first : first + 256]
                total = int(some.sum())
                flat = planes[0, at : at + total].astype(np.uint32)
                for k in (1, 2, 3):
                    flat |= planes[k, at : at + total].astype(np.uint32) << np.uint32(8 * k)
                at += total
                each = length[flat]
                shift = np.repeat(begin[flat] - (np.cumsum(each) - each), each)
                found = ids[shift + np.arange(len(shift))]
                stops = np.concatenate(([0], np.cumsum(each)))[np.cumsum(some)]
                starts = np.concatenate(([0], stops[:-1]))
                data = found.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[first : first + 256], pa.int64()), pa.array([data[2 * a : 2 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "ids"],
                )

        for batch in batches:
            for k in range(batch.num_rows):
                at, bucket, digest = (batch.column(c)[k].as_py() for c in range(3))
                data = zstandard.decompress(batch.column(3)[k].as_py())
                if at != now:
                    if now is not None:
                        yield from block()
                    if bucket != -1:
                        raise RuntimeError("a block was read again with other words; the input must be replayable")
                    now, mark, doc_ids, positions, lists = at, digest, batch.column(4)[k].as_py(), data, []
                elif bucket == -1 or digest != mark:
                    raise RuntimeError("a block was read again with other words; the input must be replayable")
                else:
                    lists.append(data)
        if now is not None:
            yield from block()

    words = rows.mapInArrow(explode_words, "bucket int, block long, digest long, words binary")
    ids = words.repartition(buckets, "bucket").mapInArrow(encode_words, "block long, bucket int, digest long, data binary")
    positions = rows.mapInArrow(keep_positions, "block long, bucket int, digest long, data binary, doc_ids array<long>")
    both = positions.unionByName(ids, allowMissingColumns=True)
    gathered = both.repartition(partitions, "block").sortWithinPartitions("block", "bucket")
    return gathered.mapInArrow((lambda batches: then(assemble(batches))) if then else assemble, schema)


def _decoded(batches: Iterator[pa.RecordBatch], table: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of each row with the token-byte table."""
    of = table.__getitem__
    for batch in batches:
        out = [b"".join(map(of, np.frombuffer(x.as_py(), "<u2").tolist())) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "text_bytes"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids_sha, text_sha = [], [], []
        for ids, data in zip(batch.column("ids"), batch.column("text_bytes"), strict=True):
            ids = np.frombuffer(ids.as_py(), "<u2").astype("<u4")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(data.as_py()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def decode(ids: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``text_bytes``: the ids joined with the broadcast token-byte table."""
    shared = ids.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)
    return ids.mapInArrow(lambda batches: _decoded(batches, shared.value), f"{schema}, text_bytes binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 over 32-bit ids, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode(docs, vocabulary, pattern, lambda batches: _digested(_decoded(batches, shared.value)), schema)
