"""Exact order by hash without a one-task sort.

The order of md5(seed ':' key) is a reproducible shuffle of the keys. Its
first hex digits spread distinct keys evenly, so the rank of a key is the
number of keys in lower buckets (a table bounded by the number of buckets)
plus its rank inside its own bucket (a small, evenly sized window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CUTOFF_DIGITS = 4  # 16^4 = 65,536 buckets
_RANK_DIGITS = 3  # 4,096 buckets per group


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _bucket(h: Column, digits: int) -> Column:
    return F.substring(h, 1, digits)


def cutoff(keys: DataFrame, key: str, seed: int, wanted: Column) -> DataFrame:
    """One row, one column: the hash of the `wanted`-th distinct key, or a
    string above every hash if there are fewer keys. `wanted` may use
    `n_keys`, the number of distinct keys."""
    hashed = keys.select(hash_order(F.col(key), seed).alias("h")).distinct()
    counts = hashed.groupBy(_bucket(F.col("h"), _CUTOFF_DIGITS).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most 65,536 rows: a window without partitions is safe here.
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    target = (
        counts.withColumn("upto", F.sum("n").over(running))
        .withColumn("n_keys", F.sum("n").over(Window.partitionBy()))
        .withColumn("wanted", wanted)
        .filter((F.col("upto") - F.col("n") < F.col("wanted")) & (F.col("upto") >= F.col("wanted")))
        .select("bucket", (F.col("wanted") - F.col("upto") + F.col("n")).alias("place"))
    )
    inside = Window.partitionBy("bucket").orderBy("h")
    hit = (
        hashed.withColumn("bucket", _bucket(F.col("h"), _CUTOFF_DIGITS))
        .join(F.broadcast(target), "bucket")  # one row
        .withColumn("rn", F.row_number().over(inside))
        .filter(F.col("rn") == F.col("place"))
    )
    return hit.agg(F.coalesce(F.max("h"), F.lit("~")).alias("h"))


def first_by_hash(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The n keys that come first in hash order, with all their rows."""
    edge = cutoff(df, key, seed, F.lit(n)).scalar()
    return df.filter(hash_order(F.col(key), seed) <= edge)


def rank_within(df: DataFrame, group: str, key: str, seed: int, out: str) -> DataFrame:
    """1-based rank by hash inside each group. Equals row_number() over
    (partition by group order by hash), but a group that holds a third of all
    rows is spread over the hash buckets instead of one task. NULL groups form
    one group, like in any window."""
    keyed = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", _bucket(F.col("_h"), _RANK_DIGITS))
    sizes = keyed.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_c")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # At most 4,096 rows per group.
    lower = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_g", "_c", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_b").orderBy("_h", key)
    ranked = keyed.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
        .withColumn(out, F.col("_before") + F.col("_rn"))
        .drop("_h", "_b", "_g", "_c", "_before", "_rn")
    )
