"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, shared_dir  # noqa: F401 - the tests of this subpackage ask for the folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: lineage ends here.

    Lost executors cost a re-read of these files, not a recomputation. A table at a named ``path``
    stays; one of our own goes when the interpreter ends.
    """
    spark = df.sparkSession
    if path is not None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Partitions that a size may ask for, at most.
MOST_PARTITIONS = 1 << 16


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions for the bytes that ``df`` reads: file sizes for a file scan.

    Where the optimizer knows no size, the session's number of shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_PARTITIONS, max(1, -(-size // bytes_each)))


def fold_of(doc_id, modulus: int):
    """crc32 of the decimal doc_id, modulo ``modulus``; null ids fall into fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


#: Hashes below a share of this range are kept before a sample is sorted.
_HASHES = 1 << 63


def hashed(salt: str):
    """63 bits of a hash of doc_id."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(salt)), 1)


def below(h, wanted: int, there):
    """Passes about three times the wanted rows of ``there`` rows, those with the smallest hashes.

    So only a bounded number of rows, not some from every task, is sorted in one place.
    """
    return h < F.least(F.lit(1.0), F.try_divide(F.lit(3.0 * wanted), there)) * float(_HASHES)


def smallest(rows: DataFrame, wanted: int, salt: str) -> DataFrame:
    """``rows`` with ``h``: the ``wanted`` ones with the smallest hash of doc_id."""
    n = rows.count()
    marked = rows.withColumn("h", hashed(salt))
    return marked.filter(below(F.col("h"), wanted, F.lit(float(max(n, 1))))).orderBy("h", *rows.columns).limit(wanted)


#: Whole numbers are sums of values in units of 1 / UNITS, so they are the same in any order.
UNITS = float(1 << 32)


def weighed(parts: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """(documents, coordinates, means) of rows (i, v): ``v`` in units times the documents of its part, those alone at i = -1."""
    found = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(28,0)")).cast("double").alias("v")).toArrow()
    i, v = (found.column(c).to_numpy() for c in ("i", "v"))
    order = np.argsort(i)
    i, v = i[order], v[order]
    return (float(v[0]), i[1:], v[1:] / UNITS / v[0]) if len(i) else (0.0, i, v)


class Packer:
    """Whole numbers from 0 to 2**32 - 1 as compressed planes of bytes."""

    def __init__(self) -> None:
        self._press, self._unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, numbers: np.ndarray) -> bytes:
        return self._press.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(self._unpress.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


class Least:
    """For each key the least of the byte strings seen by its checksum; says where one is less than those before it.

    So of many rows of one key a task passes on few, and what is left is decided where they meet.
    """

    def __init__(self) -> None:
        self._seen: dict = {}

    def passes(self, key, data: bytes) -> int | None:
        tie = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
        if tie >= self._seen.get(key, 1 << 63):
            return None
        self._seen[key] = tie
        return tie


def slices(batches, rows: int):
    """The batches in pieces of at most ``rows`` rows."""
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            yield whole.slice(k, rows)


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """Maximal runs without space, tab, LF, VT, FF, CR, as UTF-8; ``lower`` lowers A-Z only."""
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()
