"""Windowed metrics over the prediction log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unique_predictions(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each prediction id once. State is dropped once the watermark passes, so
    a repeat must arrive within `lateness`."""
    return log.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])


def windowed_metrics(
    log: DataFrame, length: str = "1 day", slide: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """window_start, window_end and the log metrics of each tumbling or
    sliding window. Rows later than the watermark are dropped (late_rows()
    counts them). Median and p95 are exact and interpolated, as in the batch
    metrics; the state of a window keeps one entry for each distinct latency."""
    window = F.window("created_at", length, slide)
    total = F.count(F.lit(1))
    return (
        log.withWatermark("created_at", lateness)
        .groupBy(window.alias("w"))
        .agg(
            total.alias("total_requests"),
            F.count_if(F.col("routed_to") == "hybrid").alias("routed_to_hybrid"),
            F.count_if(F.col("reliability") == "low").alias("low_reliability_count"),
            F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
            F.round(F.avg("routing_score"), 4).alias("avg_routing_score"),
            F.percentile("latency_ms", [0.5, 0.95]).alias("q"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "total_requests",
            "routed_to_hybrid",
            "low_reliability_count",
            "avg_latency_ms",
            "avg_routing_score",
            F.round(F.col("q")[0], 2).alias("p50_latency_ms"),
            F.round(F.col("q")[1], 2).alias("p95_latency_ms"),
        )
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into a Parquet table (append mode)."""
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_upserts(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run in update mode: every batch stores the windows it changed, the open
    ones too, in its own directory; a replayed batch overwrites it. Read with
    latest_windows()."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each window: what the last batch that changed it stored."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch_id"]
    last = F.max_by(F.struct(*columns), "batch_id").alias("last")
    return rows.groupBy("window_start", "window_end").agg(last).select("last.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the
    progress reports the query still keeps."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
