"""Toxicity by FTRL-proximal logistic regression (operator 8).

Features are hashed word n-grams (one and two words) and skip-grams (two words with one word
between) of the lower-cased whole text, each counted once per document. A learner goes once per
epoch over its documents with per-coordinate rates and L1 and L2 penalties; L1 leaves few non-zero
weights.

All labelled documents are learned from, with all features of their whole texts. They are dealt by a hash of
doc_id to shards of about ``SHARD_ROWS``, in its order; each shard has a learner of its own, in a task, and the weights are the
learners' means by documents (parameter mixing), added up in Spark. Up to ``SHARD_ROWS`` documents are one shard, so one learner.
A shard whose features exceed ``PART_BYTES`` has several learners, one after the other. A doc_id that stands on several rows of
either table is learned from once for each label, from the text whose features have the smallest checksum. What comes to the
driver is a weight for each coordinate, 2**20 + 1 at most.

Defined results: a null or empty text has no features and is scored by the bias alone; with no
labelled rows all scores are (nearly) 0; documents with both labels count once for each; null labels
and null doc_ids are not learned from, and a null doc_id is never held out; repeated rows are
scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNITS, Least, Packer, fold_of, hashed, smallest, weighed, written

BITS = 20
SHARD_ROWS = 20_000
#: Packed features that a learner holds at most (but for a single document's).
PART_BYTES = 1 << 26
#: Labels up to which they are broadcast; beyond, documents and labels meet in a shuffle.
BROADCAST_ROWS = 1_000_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.0, 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

_WORD = re.compile(r"[^\W_]+")
_SHIFT = np.uint64(64 - BITS)


def _mixed(h: np.ndarray, tag: int) -> np.ndarray:
    """Bucket numbers of 64-bit hashes (multiplicative hashing)."""
    return ((h + np.uint64(tag)) * np.uint64(0x9E3779B97F4A7C15) >> _SHIFT).astype(np.int64)


def features(text: str) -> np.ndarray:
    """The document's different feature numbers, sorted."""
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(text.lower())), np.uint64)
    if not len(h):
        return np.zeros(0, np.int64)
    high = h << np.uint64(32)
    found = [_mixed(h, 1), _mixed(high[:-1] | h[1:], 2), _mixed(high[:-2] | h[2:], 3)]
    return np.unique(np.concatenate(found))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, found: np.ndarray, label: int) -> None:
        i = np.append(found, 1 << BITS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _fitted(part: list[tuple[bytes, int]]) -> pa.RecordBatch:
    """The weights of a learner of these packed features and labels, as ``weighed`` adds them up."""
    model, packer = Ftrl(), Packer()
    for _ in range(EPOCHS):
        for f, label in part:
            model.learn(np.cumsum(packer.unpack(f), dtype=np.int64), label)
    w = np.rint(model.weights(slice(None)) * UNITS).astype(np.int64) * len(part)
    keep = np.flatnonzero(w)
    return pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1)), pa.array(np.append(w[keep], len(part)))], ["i", "v"])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Learners of a shard's rows (doc_id, toxic, f), in order; of equal doc_ids and labels the first row counts."""
    part, size, last = [], 0, None
    for batch in batches:
        for doc, label, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "f")), strict=True):
            if (doc, label) == last:
                continue
            if part and size + len(f) > PART_BYTES:
                yield _fitted(part)
                part, size = [], 0
            part.append((f, label))
            size, last = size + len(f), (doc, label)
    if part:
        yield _fitted(part)


def train(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero, of all labelled documents.

    ``rows`` is for trials, and no query gives it: only the ``rows`` ones with the smallest hash are learned from, in the driver.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, packer = Least(), Packer()
        for batch in batches:
            keep, ties, out = [], [], []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for k, (key, text) in enumerate(zip(keys, batch.column(4), strict=True)):
                f = packer.pack(np.diff(features(text.as_py() or ""), prepend=0))
                if (tie := least.passes(key, f)) is not None:
                    keep.append(k)
                    ties.append(tie)
                    out.append(f)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(ties, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "toxic", "h", "shard", "tie", "f"])

    ids = F.col("doc_id").cast("long")
    known = labels.select(ids.alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)).distinct()
    if rows is not None:
        known = smallest(known, rows, "toxicity").drop("h")
    known = written(known, "labels")
    texts = docs.select(ids.alias("doc_id"), "text")
    shards = 1 if rows is not None else max(1, -(-known.join(texts.select("doc_id"), "doc_id", "left_semi").count() // SHARD_ROWS))
    near = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    found = texts.join(near, "doc_id").withColumn("h", hashed("toxicity")).select("doc_id", "toxic", "h", (F.col("h") % shards).cast("int").alias("shard"), "text")
    found = found.mapInArrow(extract, "doc_id long, toxic int, h long, shard int, tie long, f binary")
    order = ["h", "toxic", "doc_id", "tie"]
    if rows is None:
        # A task has one shard.
        parts = found.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order).mapInArrow(_learned, "i long, v long")
    else:
        own = pa.Table.from_batches(_learned(found.orderBy(*order).toArrow().to_batches()), pa.schema([("i", pa.int64()), ("v", pa.int64())]))
        parts = docs.sparkSession.createDataFrame(own)
    n, i, w = weighed(parts)
    if not n:
        return np.array([1 << BITS]), np.array([-700.0])
    keep = np.flatnonzero(w)
    return i[keep], w[keep]


class Scorer:
    """Scores of texts by the broadcast weights; built once per task."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.weights = np.zeros((1 << BITS) + 1)
        self.weights[model[0]] = model[1]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        total = np.array([self.weights[features(t.as_py() or "")].sum() for t in texts], np.float64) + self.weights[-1]
        return 1 / (1 + np.exp(np.clip(-total, -700, 700)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            values = scorer(batch.column(2))
            arrays = [*batch.columns[:2], pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    held = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
