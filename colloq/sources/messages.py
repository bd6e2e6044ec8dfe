"""Message and pair sources: JSON lines, CSV, JSON documents, feedback logs, term lists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_text
from ..functions.times import iso_time

MESSAGE = "timestamp string, chat_id string, sender string, is_me boolean, text string"
FEEDBACK = (
    "timestamp string, message string, reply string, intent string, rating int, correction string, "
    "history array<struct<role:string,content:string>>"
)
#: Column names of exported CSV files.
CSV_COLUMNS = {"timestamp": "Date", "sender": "Sender", "text": "Message", "chat_id": "Chat"}


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).json(path)


def _messages(rows: DataFrame, mapping: dict[str, str], me: str) -> DataFrame:
    have = {c.lower(): c for c in rows.columns}
    pick = lambda name: F.col(f"`{have[mapping[name].lower()]}`").cast("string") if mapping[name].lower() in have else F.lit(None).cast("string")
    sender = F.coalesce(pick("sender"), F.lit(""))
    return rows.select(
        iso_time(pick("timestamp")).alias("timestamp"), F.coalesce(F.nullif(pick("chat_id"), F.lit("")), F.lit("unknown")).alias("chat_id"),
        sender.alias("sender"), (sender == me).alias("is_me"), F.trim(pick("text")).alias("text"),
    ).filter("text is not null and text <> ''")


def read_csv(spark: SparkSession, path: str, me: str, mapping: dict[str, str] = CSV_COLUMNS) -> DataFrame:
    """Messages of a CSV export; blank texts are dropped, a missing chat is ``unknown``."""
    return _messages(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), mapping, me)


def read_json(spark: SparkSession, path: str, me: str, mapping: dict[str, str]) -> DataFrame:
    """Messages of a JSON list, or of an object with a ``messages`` list."""
    rows = spark.read.option("multiLine", True).json(path)
    if rows.columns == ["messages"]:
        rows = rows.select(F.inline("messages"))
    return _messages(rows, mapping, me)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list of pairs as they are; see ``invalid_pairs`` for their check."""
    return spark.read.option("multiLine", True).json(path)


def invalid_pairs(rows: DataFrame) -> DataFrame:
    """n, n_invalid: rows without an instruction or a response."""
    have = set(rows.columns)
    side = lambda c: F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (c, f"{c}_clean") if x in have), F.lit(None))
    return rows.agg(F.count("*").alias("n"), F.count_if(side("instruction").isNull() | side("response").isNull()).alias("n_invalid"))


def read_corpus(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """doc_id, text, metadata of valid pairs in file order, the first ``most`` of them.

    The file must be a JSON list. ``metadata.index`` is a pair's place in it, invalid ones counted.
    """
    heads = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\uFEFF]+", "")), 1, 1).alias("c"))
    if not heads.filter("c <> '['").isEmpty():
        raise ValueError(f"{path}: expected a JSON list")
    rows = read_pairs(spark, path).withColumn("index", F.monotonically_increasing_id())
    have = set(rows.columns)
    side = lambda c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in (f"{c}_clean", c) if x in have), F.lit(None).cast("string"))
    rows = rows.select("index", side("instruction").alias("instruction"), side("response").alias("response")).filter("instruction is not null and response is not null")
    rows = rows.select(
        F.concat(F.lit("pair_"), F.col("index")).alias("doc_id"), F.concat_ws("\n", "instruction", "response").alias("text"),
        F.struct("index", "instruction", "response").alias("metadata"))
    return rows.orderBy("metadata.index").limit(most) if most is not None else rows


def read_feedback(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """The feedback log; a malformed line is an error if ``strict``, else it is skipped."""
    if strict:
        return spark.read.schema(FEEDBACK).option("mode", "FAILFAST").json(path)
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """One term a line; comments and blank lines skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("term"))
    return rows.filter("term <> '' and not startswith(term, '#')")


def read_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """All fields as one column of texts; missing ones are empty."""
    return rows.select(F.explode(F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields))).alias("text"))


def read_config(path: str):
    """A YAML file as nested dicts and lists; see ``lookup`` and ``flatten``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def read_gazetteer(paths: list[str | None], variable: str | None = None) -> tuple[str, ...]:
    """Folded terms of the first list that is there: the file that the environment variable names, else one of ``paths``.

    No list at all is no error; ``gazetteer_status`` says so.
    """
    for path in (os.environ.get(variable) if variable else None, *paths):
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return tuple(sorted({fold_text(line.strip()) for line in f if line.strip() and not line.startswith("#")}))
    return ()


def gazetteer_status(terms: tuple[str, ...]) -> str:
    return f"{len(terms)} confirmed surname stems loaded" if terms else "no surname gazetteer: only distinctive endings are detected"


def lookup(tree: dict, path: str, default=None):
    """A value of a nested configuration by dotted path."""
    for key in path.split("."):
        if not isinstance(tree, dict) or key not in tree:
            return default
        tree = tree[key]
    return tree


def flatten(tree, indent: int = 0) -> list[str]:
    """A configuration tree as lines ``label: value``."""
    pad = "  " * indent
    if isinstance(tree, dict):
        out = []
        for k, v in tree.items():
            label = str(k).replace("_", " ")
            out += [f"{pad}{label}:", *flatten(v, indent + 1)] if isinstance(v, dict | list) else [f"{pad}{label}: {v}"]
        return out
    return [f"{pad}- {x}" if not isinstance(x, dict | list) else line for x in tree for line in (flatten(x, indent) if isinstance(x, dict | list) else [""])]


def without_keys(tree, drop: set[str]):
    """A configuration tree without the named keys, at any depth."""
    if isinstance(tree, dict):
        return {k: without_keys(v, drop) for k, v in tree.items() if k not in drop}
    return [without_keys(v, drop) for v in tree] if isinstance(tree, list) else tree
