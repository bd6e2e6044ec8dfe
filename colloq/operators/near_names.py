"""Near misses of known names, without comparing every token with every name.

The ratio of matching blocks is 2 M / (length of both), and M characters in common order leave
(1 - ratio) * (length of both) characters at most to delete and insert. A name is cut into so many
segments that one of them must have one such edit or none. So the token holds that segment, or the segment
less a character, or a piece that is the segment plus a character within it. Those
are keys of an equality join; positions, lengths, characters that the other lacks and the edits themselves filter its hits without
loss, and the ratio is measured last, of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import written

#: Keys of names that are broadcast at most (about 40 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Names up to this length have their edits counted in one 64-bit word; longer ones go to the ratio uncounted.
_WORD = 61
_EPS = 1e-9


def edits_allowed(a: Column, b: Column, ratio: float) -> Column:
    """Characters to delete and insert between texts of these lengths, at most."""
    return F.floor((a + b) * (1 - ratio) + _EPS)


def segments(length: int, ratio: float) -> list[tuple[int, int]]:
    """(begin from 0, length) of a name's segments: one more than half of the edits that any token may need."""
    longest = floor(length * (2 - ratio) / ratio + _EPS)
    edits = floor((longest + length) * (1 - ratio) + _EPS)
    k = edits // 2 + 1
    if length < 2 * k:
        raise ValueError(f"a ratio of {ratio} leaves no segment of two characters in a name of {length}")
    cuts = [length * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _less_one(text: Column, size: int, first: int, last: int) -> Column:
    """The text of ``size`` characters without the character at each place from first to last (from 1)."""
    return F.array(*(F.concat(F.substring(text, 1, i - 1), F.substring(text, i + 1, size - i)) for i in range(first, last + 1)))


def name_keys(names: DataFrame, lengths: list[int], ratio: float) -> DataFrame:
    """name, size, key, at: keys of each segment of the names (name)."""
    rows = []
    for n in lengths:
        each = []
        for begin, size in segments(n, ratio):
            part = F.substring("name", begin + 1, size)
            each.append(F.struct(F.lit(size).alias("size"), F.lit(begin).alias("at"), F.array_union(F.array(part), _less_one(part, size, 1, size)).alias("keys")))
        rows.append((n, F.array(*each)))
    all_ = None
    for n, each in rows:
        all_ = F.when(F.length("name") == n, each) if all_ is None else all_.when(F.length("name") == n, each)
    return names.select("name", F.explode(all_).alias("s")).select("name", "s.size", "s.at", F.explode("s.keys").alias("key"))


def token_keys(tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """token, size, key, at: every piece of a token that may meet a segment of one of the sizes."""
    token = F.col("token")

    def pieces(size: int, width: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.length(token)), lambda p: p + width <= F.length(token))
        if width <= size:
            keys = lambda p: F.array(F.substring(token, p + 1, F.lit(width)))
        else:  # the added character is within the piece
            keys = lambda p: F.array(*(F.concat(F.substring(token, p + 1, F.lit(i - 1)), F.substring(token, p + 1 + i, F.lit(width - i))) for i in range(2, width)))
        return F.flatten(F.transform(places, lambda p: F.transform(keys(p), lambda x: F.struct(F.lit(size).alias("size"), p.alias("at"), x.alias("key")))))

    parts = [pieces(size, width) for size in sizes for width in (size - 1, size, size + 1)]
    return tokens.select("token", F.explode(F.concat(*parts)).alias("k")).select("token", "k.size", "k.at", "k.key")


def edits(token: Column, name: Column) -> Column:
    """Characters to delete and insert from one text to the other; null for names beyond ``_WORD``.

    The longest common subsequence, a bit per character of the name.
    """
    bits = F.transform(F.sequence(F.lit(0), F.length(name) - 1), lambda i: F.struct(F.substring(name, i + 1, F.lit(1)).alias("c"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("b")))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(name)) - 1

    def step(v: Column, i: Column, own: Column) -> Column:
        c = F.substring(token, i, F.lit(1))
        mask = F.aggregate(F.filter(own, lambda x: x["c"] == c), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["b"]))
        u = v.bitwiseAND(mask)
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    left = let(bits, lambda own: F.aggregate(F.sequence(F.lit(1), F.length(token)), full, lambda v, i: step(v, i, own)))
    common = F.length(name) - F.bit_count(left)
    return F.when(F.length(name) <= _WORD, F.length(token) + F.length(name) - 2 * common)


def strangers(a: Column, b: Column) -> Column:
    """Characters of either text that the other has nowhere: each of them takes an edit."""
    lacked = lambda x, y: F.length(F.call_function("translate", x, y, F.lit("")))
    return lacked(a, b) + lacked(b, a)


def candidates(tokens: DataFrame, names: DataFrame, ratio: float = 0.85) -> DataFrame:
    """token, name, edits: pairs of (token) and (name) that may have the ratio; none that has it is missing.

    Both are taken as distinct and not empty. ``ratio`` must leave segments of two characters, 0.7 and above do.
    """
    known = written(names.select("name").filter("name <> ''").distinct(), "names")
    lengths = sorted(r.n for r in known.select(F.length("name").alias("n")).distinct().collect())
    if not lengths:
        return tokens.select("token", F.lit("").alias("name"), F.lit(0).alias("edits")).limit(0)
    keys = written(name_keys(known, lengths, ratio), "name-keys")
    sizes = sorted({size for n in lengths for _, size in segments(n, ratio)})
    near = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    # Tokens that are too short or too long for every name have no keys.
    least, longest = floor(lengths[0] * ratio / (2 - ratio)), floor(lengths[-1] * (2 - ratio) / ratio) + 1
    some = tokens.select("token").filter(F.length("token").between(max(1, least), longest)).distinct()
    asked = token_keys(some, sizes)
    a, b = F.length("token"), F.length("name")
    most = edits_allowed(a, b, ratio)
    fits = (F.least(a, b) * 2 >= (a + b) * ratio - _EPS) & (F.abs(F.col("t.at") - F.col("n.at")) <= most) & (strangers(F.col("token"), F.col("name")) <= most)
    pairs = asked.alias("t").join(near.alias("n"), ["size", "key"]).filter(fits).select("token", "name").distinct()
    return pairs.withColumn("edits", edits(F.col("token"), F.col("name"))).filter(F.coalesce(F.col("edits"), F.lit(0)) <= most)


def measured(pairs: DataFrame, ratio: float = 0.85) -> DataFrame:
    """token, name, ratio: the best name of each token (the last in order on ties) with at least the ratio."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for batch in batches:
            best = [max((SequenceMatcher(None, t, n).ratio(), n) for n in near) for t, near in zip(batch["token"], batch["near"], strict=True)]
            out = pd.DataFrame({"token": batch["token"], "name": [b[1] for b in best], "ratio": [b[0] for b in best]})
            yield out[out["ratio"] >= ratio]

    grouped = pairs.groupBy("token").agg(F.collect_set("name").alias("near"))  # the names near one token
    return grouped.mapInPandas(measure, "token string, name string, ratio double")
