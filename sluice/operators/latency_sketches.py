"""Percentiles of latencies that aren't whole numbers, from stored sketches.

One KLL sketch for each day and backend (any keys) is stored beside the log: a
few kilobytes for any number of rows. Sketches merge, so percentiles of a week, a
backend, or everything come from them without reading the log again; a stream may
store one row of sketches a batch and let readers merge them. `k` bounds the
error: the true rank of an answer is off by at most RANK_ERROR(k) of the rows,
with 99 % confidence, merged or not; up to k rows it is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 2_000
PERCENTILES = (0.5, 0.95)


def rank_error(k: int) -> float:
    """Published bound of the sketch for one rank, 99 % confidence."""
    return 2.296 / k**0.9021


def latency_sketches(log: DataFrame, keys: Sequence[str], latency: str, k: int = K) -> DataFrame:
    """keys, n, sketch: one grouping; tasks send sketches, not latencies. Rows
    without a latency, or with NaN, count for nothing."""
    value = F.nanvl(F.col(latency).cast("double"), F.lit(None).cast("double"))
    known = log.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str, day: str = "day") -> None:
    """Replace the sketches of the days that are given, leave other days alone:
    writing a day again doesn't count it twice."""
    (
        sketches.write.mode("overwrite")
        .partitionBy(day)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def percentile(sketch: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p))


def rolled_up(
    sketches: DataFrame, keys: Sequence[str] = (), k: int = K, percentiles: Sequence[float] = PERCENTILES
) -> DataFrame:
    """keys, n, and one column for each percentile, of all sketches with these
    keys. Without keys: one row, of zero rows and NULL if there are none."""
    merged = sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("s")
    )
    answers = [F.when(F.col("n") > 0, percentile(F.col("s"), p)).alias(f"p{round(100 * p)}") for p in percentiles]
    return merged.select(*keys, "n", *answers)
