"""Continuous classify-and-log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.centroids import CentroidModel
from sluice.plans.cascade import classify, log_rows
from sluice.session import StageStore
from sluice.sources.prediction_log import replace_batch


def read_stream(spark: SparkSession, folder: str, like: DataFrame, **options: str) -> DataFrame:
    """Files of a folder as a stream; streams take no inferred schema."""
    return spark.readStream.schema(like.schema).options(**options).parquet(folder)


def table_stream(spark: SparkSession, table: str, like: DataFrame, **options: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: a stream's path
    must be a folder unless it is a pattern, so the name is put as one."""
    folder, name = table.rstrip("/").rsplit("/", 1)
    return read_stream(spark, f"{folder}/{{{name}}}", like, **options)


def classify_stream(
    reports: DataFrame,
    model: CentroidModel,
    log: str,
    rejects: str,
    checkpoint: str,
    run_id: str,
    backend: str = "window_mean",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Classify a stream of report_id, text. The stages aggregate twice, so
    they run inside the batch function. Invalid rows go to the rejects table
    and the stream goes on; a failing write stops it, and the replayed batch
    overwrites its own directory: each report is logged exactly once. trigger:
    what DataStreamWriter.trigger takes, e.g. {"processingTime": "1 minute"} for
    a stream that keeps running; by default what is there is drained. options
    go to classify()."""
    spark = reports.sparkSession

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        store = StageStore(spark)
        try:
            # One copy of the batch: a file source would be read once per stage.
            rows = store.put("batch", batch.select("report_id", "text"))
            done = classify(rows, model, store, backend, run_id, **options)
            replace_batch(log_rows(done, rows), log, batch_id)
            done.rejects.write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        finally:
            store.drop()

    return (
        reports.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
