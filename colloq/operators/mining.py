"""Candidates for a surname list: words that often stand where a name is expected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import fold, fold_text, letter_runs
from ..session import written
from .privacy import given_name, surname

#: Noncharacters that mark a captured span; a text that holds them has a third one in their place.
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def around_group(pattern: str) -> tuple[str, str, str]:
    """What stands before, in and after the only capturing group of a pattern, which must not be nested."""
    inside, depth, begin = False, 0, -1
    for m in re.finditer(r"\\.|\[\^?\]?|\]|\(\?|\(|\)", pattern):
        part = m.group()
        if part[0] == "[" and not inside:
            inside = True
        elif part == "]":
            inside = False
        elif inside or part[0] == "\\":
            continue
        elif part == ")":
            depth -= 1
            if begin >= 0 and depth == level:
                return pattern[:begin], pattern[begin + 1 : m.start()], pattern[m.end() :]
        else:
            if part == "(":
                begin, level = m.start(), depth
                if depth:
                    raise ValueError(f"the group of {pattern!r} is nested")
            depth += 1
    raise ValueError(f"{pattern!r} has no capturing group")


def marked(text: Column, pattern: str) -> Column:
    """The text with the group of every match between marks, by one replacement. Letters of either case match."""
    before, name, after = around_group(pattern)
    held = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    plain = F.when(held, F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)
    return F.regexp_replace(plain, f"(?iU)((?:{before}))({name})((?:{after}))", f"$1{_OPEN}$2{_CLOSE}$3")


def captures(text: Column, pattern: str) -> Column:
    """array<struct<start int, word string>>: the group's text in every match, with its place in the text.

    The places are running sums over the lengths of the parts between marks.
    """
    parts = F.split(marked(text, pattern), f"[{_OPEN}{_CLOSE}]")  # captured ones are every second
    none = F.array().cast("array<struct<start:int,word:string>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("captured"), none.alias("found"))

    def step(s: Column, part: Column) -> Column:
        one = F.struct(s["at"].alias("start"), part.alias("word"))
        return F.struct(
            (s["at"] + F.length(part)).alias("at"), (~s["captured"]).alias("captured"),
            F.when(s["captured"], F.array_append(s["found"], one)).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(parts, begin, step, lambda s: s["found"])


def framed_words(text: Column, frames: Sequence[str] = V.NAME_FRAMES) -> Column:
    """The captured spans of all frames, each span once however many frames capture it."""
    return F.array_distinct(F.concat(*(captures(text, f) for f in frames)))


def framed_counts(texts: DataFrame, text: str, frames: Sequence[str]) -> DataFrame:
    """word, n: how often each word is a captured span, as ``framed_words`` has them; added up within a batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = re.compile(f"[{_OPEN}{_CLOSE}]")
        for batch in batches:
            found: Counter[str] = Counter()
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = set()
                for one in row:
                    at = 0
                    for k, part in enumerate(between.split(one)):
                        if k % 2:
                            spans.add((at, part))
                        at += len(part)
                found.update(word for _, word in spans)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = texts.filter(F.col(text).isNotNull()).select(*(marked(F.col(text), f).alias(f"m{k}") for k, f in enumerate(frames)))
    return rows.mapInArrow(run, "word string, n long")


def without_prefix(words: DataFrame, stems: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """Rows of ``words`` whose word begins with none of ``stems``, whatever their number.

    Every prefix of every word looks for its equal among the stems: hash joins, no comparison of all words with all stems.
    """
    starts = words.select(word).distinct().withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(F.col(word), F.lit(1), n))))
    known = stems.select(fold(F.col(stem)).alias("_prefix")).filter("_prefix <> ''").distinct()
    return words.join(starts.filter(F.length(word) > 0).join(known, "_prefix", "left_semi").select(word).distinct(), word, "left_anti")


def mine_surnames(texts: DataFrame, text: str, frames: Sequence[str] = V.NAME_FRAMES, noise: Sequence[str] = V.FRAME_NOISE,
                  gazetteer: DataFrame | None = None, own: Sequence[str] = (), least: int = 2) -> DataFrame:
    """word, frames, total, ratio: words that stand in name frames ``least`` times, the highest share of them first.

    A captured span counts once, however many frames capture it, so no ratio is above 1 where every
    captured word is a run of letters. Left out: ``noise``, own names, words that the surname or given-name rules know, and words
    that begin with a stem of ``gazetteer`` (stem). Occurrences and frames are counted by the words as
    they stand, and folded then. Null texts hold nothing.
    """
    spans = framed_counts(texts, text, frames).select("word", F.col("n").alias("frames"), F.lit(0).cast("long").alias("total"))
    runs = texts.select(F.explode(letter_runs(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    # Words are folded once each, not wherever they stand.
    raw = spans.unionByName(runs.select("word", F.lit(0).cast("long").alias("frames"), "total")).groupBy("word").agg(F.sum("frames").alias("frames"), F.sum("total").alias("total"))
    counted = raw.groupBy(fold(F.col("word")).alias("word")).agg(F.sum("frames").alias("frames"), F.sum("total").alias("total"))
    drop = sorted({fold_text(x) for x in (*noise, *own)})
    # Written: the counts are read twice below, the texts once.
    kept = written(counted.filter(F.col("frames") >= least), "counted")
    kept = kept.filter(~F.col("word").isin(*drop) & ~surname(F.col("word")) & ~given_name(F.col("word")))
    if gazetteer is not None:
        kept = without_prefix(kept, gazetteer)
    return kept.withColumn("ratio", F.col("frames") / F.greatest("total", F.lit(1))).orderBy(F.desc("ratio"), F.desc("frames"), "word")


def with_places(rows: DataFrame, text: str, frames: Sequence[str] = V.NAME_FRAMES, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each captured span: the keys, start and word; to look at candidates where they stand."""
    found = rows.select(*keys, F.explode(framed_words(F.col(text), frames)).alias("s"))
    return found.select(*keys, "s.start", "s.word")


def ranked_report(candidates: DataFrame, most: int = 50) -> DataFrame:
    """The first candidates as report lines."""
    line = F.format_string("%10d  %7d  %6.0f%%  %s", "frames", "total", F.col("ratio") * 100, "word")
    return candidates.orderBy(F.desc("ratio"), F.desc("frames"), "word").limit(most).select("word", line.alias("line"))

