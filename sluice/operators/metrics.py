"""Metrics over the prediction log.

Latencies are whole milliseconds, so a histogram of the log by day, backend,
reliability and latency is small. It is built in one scan of five columns with
map-side sums; every metric, with exact percentiles, comes from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.95)


def log_histogram(log: DataFrame) -> DataFrame:
    """day, routed_to, reliability, latency_ms, n_rows, n_ids, n_scores, score_sum."""
    day = F.to_date("created_at") if "created_at" in log.columns else F.lit(None).cast("date")
    return log.groupBy(day.alias("day"), "routed_to", "reliability", "latency_ms").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("id").alias("n_ids"),
        F.count("routing_score").alias("n_scores"),
        F.sum("routing_score").alias("score_sum"),
    )


def _whole(count: Column) -> Column:
    return F.coalesce(F.sum(count), F.lit(0))


def _metrics() -> list[Column]:
    """Of rows of a histogram; percentile() takes each latency with its count
    and keeps one entry for each distinct latency."""
    total = _whole(F.col("n_ids"))
    hybrid = _whole(F.when(F.col("routed_to") == "hybrid", F.col("n_rows")))
    low = _whole(F.when(F.col("reliability") == "low", F.col("n_rows")))
    known = F.col("latency_ms").isNotNull()
    mean = F.try_divide(
        F.sum(F.col("latency_ms").cast("double") * F.col("n_rows")), F.sum(F.when(known, F.col("n_rows")))
    )
    return [
        total.alias("total_requests"),
        hybrid.alias("routed_to_hybrid"),
        (total - hybrid).alias("routed_to_fallback"),
        low.alias("low_reliability_count"),
        F.round(F.try_divide(total - hybrid, total), 4).alias("fallback_rate"),
        F.round(F.try_divide(low, total), 4).alias("low_reliability_rate"),
        F.round(mean, 2).alias("avg_latency_ms"),
        F.round(F.try_divide(F.sum("score_sum"), F.sum("n_scores")), 4).alias("avg_routing_score"),
        *_latencies(),
    ]


def _latencies() -> list[Column]:
    return [
        F.round(F.percentile("latency_ms", F.lit(p), F.col("n_rows")), 2).alias(f"p{round(100 * p)}_latency_ms")
        for p in PERCENTILES
    ]


def latency_percentiles(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, p50_latency_ms, p95_latency_ms (exact, interpolated)."""
    return log.groupBy(*keys, "latency_ms").agg(F.count(F.lit(1)).alias("n_rows")).groupBy(*keys).agg(*_latencies())


def log_metrics(log: DataFrame) -> DataFrame:
    """The metrics row; an empty log gives one row of zeros."""
    return log_histogram(log).agg(*_metrics()).na.fill(0)


def log_metrics_by(log: DataFrame) -> DataFrame:
    """The same by backend, by reliability, by day and overall. `level` tells
    the sets apart, the columns a set does not group by are NULL. The four
    sets multiply rows of the histogram, not of the log."""
    none = F.lit(None)
    sets = F.array(*[
        F.struct(
            F.lit(level).alias("level"),
            (F.col("routed_to") if level == "backend" else none.cast("string")).alias("backend"),
            (F.col("reliability") if level == "reliability" else none.cast("string")).alias("rel"),
            (F.col("day") if level == "day" else none.cast("date")).alias("of_day"),
        )
        for level in ("all", "backend", "reliability", "day")
    ])
    histogram = log_histogram(log)
    rows = histogram.select(F.explode(sets).alias("g"), *histogram.columns)
    rows = rows.select("g.*", *[c for c in histogram.columns if c != "day"])
    return (
        rows.groupBy("level", "backend", "rel", "of_day")
        .agg(*_metrics())
        .withColumnsRenamed({"rel": "reliability", "of_day": "day"})
    )
