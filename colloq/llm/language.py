"""Language identification by error-correcting output codes (operator 7).

Every language gets a codeword, one bit for each column of the code. No column repeats another or
its complement, so every bit is a question of its own: up to ``EXHAUSTIVE`` languages have every
dichotomy as a column, more languages have seeded columns, of which those are kept that leave the
closest codewords farthest apart. One binary logistic classifier per bit over hashed character
n-grams (one to three letters of the lower-cased text, words padded) predicts the bit. A text's
decoding loss for a language is the mean over bits of the bit's weight (its training accuracy
above chance) times the logistic loss of its margin against the codeword; the language of least
loss is chosen, ``score`` is its share of exp(-``SHARPNESS`` * loss), and a share under
``AMBIGUOUS`` flags the text.

Training learns from all documents of every language. They are dealt by a hash of doc_id to shards of
about ``ROWS_PER_LANGUAGE`` times the number of languages (``SHARD_ROWS`` where that would be more; one of each at least); each
shard trains the classifiers on its documents, in a task, languages weighing alike, and the model has the means of weights and
training accuracies by documents (parameter mixing), added up in Spark. A language with too few documents to give each shard half
of an equal share stands in several shards with the same documents, so that no shard lacks it. Up to one shard's rows there is one. A
doc_id that stands on several rows is learned from once for each of its languages, from the text whose packed counts have the
smallest checksum. Prediction reads whole texts.

Defined results: null text or no letter: ``und``, score 0, not ambiguous; nothing to learn from:
``und`` for all; ties go to the language first in the alphabet; a null doc_id is never held out
nor learned from, nor is an empty lang; repeated rows are predicted alike; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UNITS, Least, Packer, below, fold_of, hashed, slices, weighed

BITS = 12
ROWS_PER_LANGUAGE, SHARD_ROWS = 500, 4_000
#: Shards that a task trains one after the other.
SHARDS_A_TASK = 4
#: Languages up to which the code has every dichotomy.
EXHAUSTIVE = 6
SHARPNESS, AMBIGUOUS = 31.0, 0.6
STEPS = 150
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_BLOCK = 65_536


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text (2**BITS); all zero without a letter."""
    out = np.zeros(1 << BITS, np.float64)
    # The pattern also finds numerals such as fractions; a word must hold a letter.
    words = [w for w in _LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]
    for k in range(0, len(words), _BLOCK):
        data = " " + " ".join(words[k : k + _BLOCK]) + " "
        c = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        space = c == 32
        two = c[:-1] * np.uint64(0x1F123BB5) + c[1:]
        three = two[:-1] * np.uint64(0x1F123BB5) + c[2:]
        keep2 = ~(space[:-1] & space[1:])
        for tag, h in ((1, c[~space]), (2, two[keep2]), (3, three[~space[1:-1]])):
            bucket = (h * np.uint64(8) + np.uint64(tag)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            out += np.bincount(bucket.astype(np.int64), minlength=1 << BITS)
    return out


def vector(found: np.ndarray) -> np.ndarray:
    """Square roots of shares: unit length, whatever the text's length."""
    return np.sqrt(found / max(found.sum(), 1.0))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 in columns that differ from each other and from each other's complement.

    The first language has +1 throughout. Up to ``EXHAUSTIVE`` languages: all 2**(n - 1) - 1 columns, whose
    rows are 2**(n - 2) apart. Beyond: of seeded draws of 15 * log2(n) columns, the one whose
    closest rows are farthest apart.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        return np.array([[-1 if k and c >> k - 1 & 1 else 1 for c in range(1, 2 ** (n - 1))] for k in range(n)])
    rng, bits, best, most = np.random.default_rng(7), int(np.ceil(15 * np.log2(n))), None, -1
    for _ in range(20):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = rng.integers(0, 2, n)
            c ^= c[0]
            if n <= 4 * c.sum() <= 3 * n:
                columns.setdefault(np.packbits(c).tobytes(), c)
        code = 1 - 2 * np.array(list(columns.values())).T
        apart = (bits - code @ code.T) // 2
        np.fill_diagonal(apart, bits + 1)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


class Model:
    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages)).astype(np.float32)
        bits = self.code.shape[1]
        target = self.code[y]
        share = np.bincount(y, minlength=len(languages)).astype(np.float64)
        weight = (1 / share[y] / len(languages)).astype(np.float32)[:, None]
        w = np.zeros((x.shape[1], bits), np.float32)
        b = np.zeros(bits, np.float32)
        m = np.zeros_like(w)
        x = x.astype(np.float32, copy=False)
        for _ in range(STEPS):  # full-batch descent with momentum
            g = -target * weight / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
            m = 0.9 * m - 20.0 * (x.T @ g + 1e-5 * w)
            w += m
            b -= 2.0 * g.sum(0)
        self._keep(w, b, ((x @ w + b) * target > 0).mean(0))

    def _keep(self, w: np.ndarray, b: np.ndarray, right: np.ndarray) -> None:
        self.w, self.b, self.right = w, b, right
        self.bit_weight = np.maximum(2 * right - 1, 0.01).astype(np.float64)

    def flat(self) -> np.ndarray:
        """Weights, biases and training accuracies."""
        return np.concatenate([self.w.ravel(), self.b, self.right]).astype(np.float64)

    @classmethod
    def of(cls, languages: list[str], flat: np.ndarray) -> Model:
        model = cls.__new__(cls)
        model.languages, model.code = languages, codewords(len(languages)).astype(np.float32)
        bits = model.code.shape[1]
        model._keep(flat[: -2 * bits].reshape(-1, bits).astype(np.float32), flat[-2 * bits : -bits].astype(np.float32), flat[-bits:])
        return model

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, share) for each row."""
        return self.nearest((x.astype(np.float32) @ self.w + self.b).astype(np.float64))

    def nearest(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, share) of the codeword of least loss for each row of margins, one for each bit."""
        loss = np.empty((len(margin), len(self.languages)))
        for k, c in enumerate(self.code):
            loss[:, k] = (np.logaddexp(0, -margin * c) * self.bit_weight).mean(1)
        p = np.exp(SHARPNESS * (loss.min(1, keepdims=True) - loss))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def train(docs: DataFrame, rows: int | None = None) -> Model | None:
    """The model of all documents; none if there is nothing to learn from.

    ``rows`` is for trials, and no query gives it: only the ``rows`` documents of each language with the smallest hash are
    learned from, in the driver.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, packer = Least(), Packer()
        for batch in batches:
            keep, ties, out = [], [], []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for k, (key, text) in enumerate(zip(keys, batch.column(4), strict=True)):
                x = packer.pack(counts(text.as_py()))
                if (tie := least.passes(key, x)) is not None:
                    keep.append(k)
                    ties.append(tie)
                    out.append(x)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(ties, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "k", "h", "chunks", "tie", "x"])

    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    usable = usable.filter("doc_id is not null and text is not null and lang is not null and lang <> ''")
    usable = usable.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    found = dict(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).cast("double")).collect())
    if not found:
        return None
    languages = sorted(found)
    each = max(1, min(ROWS_PER_LANGUAGE, SHARD_ROWS // len(languages)))
    shards = 1 if rows is not None else max(1, round(sum(found.values()) / (each * len(languages))))
    # A language's documents are dealt to its chunks; shard s has chunk s % chunks.
    chunks = [max(1, min(shards, int(found[lang] / max(1, each // 2)))) for lang in languages]
    names = docs.sparkSession.createDataFrame(list(zip(languages, range(len(languages)), chunks, found.values(), strict=True)), "lang string, k int, chunks int, n double")
    # As many rows as the model has languages; in a shuffle a language's texts would meet in one task.
    usable = usable.join(F.broadcast(names), "lang").withColumn("h", hashed("language"))
    if rows is not None:
        first = Window.partitionBy("k").orderBy("h", "doc_id")
        ids = usable.filter(below(F.col("h"), rows, F.col("n"))).select("doc_id", "k", "h").distinct()
        ids = ids.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rows).select("doc_id", "k")
        usable = usable.join(ids, ["doc_id", "k"])
    packed = usable.select("doc_id", "k", "h", "chunks", "text").mapInArrow(extract, "doc_id long, k int, h long, chunks int, tie long, x binary")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Models of sorted rows (shard, h, k, doc_id, x), as ``weighed`` adds them up; of equal doc_ids and languages the first row counts."""
        packer, total, n = Packer(), 0, 0
        rows_of = (zip(*(b.column(c).to_pylist() for c in ("shard", "h", "k", "doc_id", "x")), strict=True) for b in batches)
        for _, own in groupby(chain.from_iterable(rows_of), lambda r: r[0]):
            one = [next(same)[2::2] for _, same in groupby(own, lambda r: r[:4])]
            x = np.empty((len(one), 1 << BITS), np.float32)
            for row, (_, packed_row) in zip(x, one, strict=True):
                row[:] = vector(packer.unpack(packed_row))
            model = Model(languages, x, np.array([k for k, _ in one]))
            total = total + np.rint(model.flat() * UNITS).astype(np.int64) * len(one)
            n += len(one)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.insert(total, 0, n))], ["i", "v"])

    order = ["shard", "h", "k", "doc_id", "tie"]
    if rows is None:
        dealt = packed.withColumn("shard", F.explode(F.sequence((F.col("h") % F.col("chunks")).cast("int"), F.lit(shards - 1), F.col("chunks")))).drop("chunks")
        dealt = dealt.repartitionById(-(-shards // SHARDS_A_TASK), F.expr(f"shard div {SHARDS_A_TASK}").cast("int"))
        parts = dealt.sortWithinPartitions(*order).mapInArrow(learned, "i long, v long")
    else:
        own = packed.withColumn("shard", F.lit(0)).orderBy(*order).toArrow().to_batches()
        parts = docs.sparkSession.createDataFrame(pa.Table.from_batches(learned(own), pa.schema([("i", pa.int64()), ("v", pa.int64())])))
    n, _, flat = weighed(parts)
    return Model.of(languages, flat) if n else None


def _judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, share, ambiguous) of each text."""
    found = np.stack([counts(t.as_py() or "") for t in texts])
    some = found.sum(1) > 0
    lang = np.full(len(found), UNKNOWN, object)
    value = np.zeros(len(found))
    if model is not None and some.any():
        best, value[some] = model.decode(np.sqrt(found[some] / found[some].sum(1, keepdims=True)))
        lang[some] = np.array(model.languages, object)[best]
    return lang, value, (lang != UNKNOWN) & (value < AMBIGUOUS)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            lang, value, flag = _judge(shared.value, batch.column(2))
            arrays = [*batch.columns[:2], pa.array(lang.tolist(), pa.string()), pa.array(value), pa.array(flag.astype(bool))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    held = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with a language that is not ambiguous, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            lang, _, flag = _judge(shared.value, batch.column(at))
            yield batch.filter(pa.array(((lang != UNKNOWN) & ~flag).astype(bool)))

    return docs.mapInArrow(run, docs.schema)
