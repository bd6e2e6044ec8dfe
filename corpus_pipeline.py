"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that the stage before it kept, is written as Parquet, and is read again
by the next; so a lost executor costs a stage at most.

All stages share these results: an empty table gives an empty table; extra columns are kept as they
are (the last stage drops them); rows with equal texts are judged alike; texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colloq.llm import language, packing, pii, simhash, toxicity
from colloq.llm.common import table, written

#: Spaced words that a packing worker remembers: the stages before it share its memory.
MEMO_WORDS = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold.

    A null or empty text is scored by the bias alone, hence kept as a rule. The model learns from
    ``labels`` of documents that are there; with none, every document stays. Null doc_ids and null
    labels are not learned from; repeated rows all stay or all go.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly.

    Null texts, texts without a letter and ambiguous ones go; with no ``lang`` to learn from all go.
    Repeated rows all stay or all go; ties between languages are ambiguous.
    """
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest doc_id.

    Texts without a word (null, empty) are one group. Where doc_ids repeat or are null, the first
    row as read stays.
    """
    return simhash.keep_one(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found spans of ``text`` replaced by their kind; a null text stays null.

    Overlapping spans are replaced as one; ``n_chars`` keeps the length of the raw text.
    """
    return pii.redact(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset.

    A null or empty text is the end id alone; rows with equal or null doc_ids are documents of
    their own; pieces of equal length are placed by doc_id, then piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_words=MEMO_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_pii),
    ("packing", pack),
]

#: Learned models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
