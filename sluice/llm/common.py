"""Small helpers the operators share: words, caches, stage tables, ranks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import StageStore

# A null id sorts after every other id.
NO_ID = np.iinfo(np.int64).max


def stage(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, two
    consumers share one computation, and a lost executor loses nothing."""
    return StageStore(spark).put(name, df)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, or name with as many underscores as it takes to clash with none
    of `taken` (Spark's column names don't tell cases apart)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null. bytes.split() then cuts at
    exactly [\\x20\\x09-\\x0D], and bytes.lower() changes A-Z only."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def int_ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def back_to_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


class WordHashes(dict):
    """Word -> 64-bit hash, filled on demand by each worker, bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def rolling_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (base a 64-bit odd number, modulus 2**64) of the window
    of `width` words that starts at each place; mixed so that every bit counts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= _BASE
        h += words[k : k + n]
    h ^= h >> np.uint64(32)
    h *= _ODD
    h ^= h >> np.uint64(29)
    return h


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts; sizes partitions, never decides what is done."""
    row = docs.agg(F.sum(F.octet_length(text))).first()
    return row[0] or 0


def pieces(total: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def numbered(
    df: DataFrame, key: str, sub: F.Column, splits: int, out: str, spark: SparkSession, order: list[str] | None = None
) -> DataFrame:
    """Gapless numbers from 0 inside each value of `key`, none of which may be
    large: rows are ranked inside (key, hash part) and lifted by the rows of
    the parts before. Only keys x splits counts are gathered."""
    from pyspark.sql import Window as W

    parted = df.withColumn("_sub", F.pmod(sub, F.lit(splits)).cast("int"))
    counts = parted.groupBy(key, "_sub").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    lifts = counts.select(
        F.col(key).alias("_key"),
        F.col("_sub").alias("_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"),
    )
    order = order or [c for c in df.columns if c != key]
    ranked = parted.withColumn(
        "_rank", F.row_number().over(W.partitionBy(key, "_sub").orderBy(*order)) - 1
    )
    same = ranked[key].eqNullSafe(lifts["_key"]) & (ranked["_sub"] == lifts["_part"])
    return (
        ranked.join(lifts, same)
        .withColumn(out, (F.col("_rank") + F.col("_lift")).cast("long"))
        .drop("_sub", "_rank", "_key", "_part", "_lift")
    )


def rank_parts(rows: float) -> int:
    """Hash parts that numbered() ranks a key in: some 20,000 rows each if all
    rows had one key, and few enough that their counts stay small."""
    return min(4096, max(64, math.ceil(rows / 20_000)))


def slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes, so that arrays stay small."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
