"""The prediction log: an append-only table, by batch and day."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("report_text", T.StringType(), False),
    T.StructField("prediction", T.StringType(), False),
    T.StructField("prediction_label", T.StringType(), False),
    T.StructField("routing_score", T.DoubleType(), False),
    T.StructField("routed_to", T.StringType(), False),
    T.StructField("reliability", T.StringType(), False),
    T.StructField("top_k_candidates", T.ArrayType(T.StringType()), False),
    T.StructField("latency_ms", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])
STORED_SCHEMA = T.StructType(
    LOG_SCHEMA.fields
    + [T.StructField("batch_id", T.StringType(), True), T.StructField("created_date", T.DateType(), True)]
)


def as_log_rows(df: DataFrame) -> DataFrame:
    """Log columns in order and type; created_at defaults to now."""
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp())
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])


def _dated(df: DataFrame) -> DataFrame:
    return as_log_rows(df).withColumn("created_date", F.to_date("created_at"))


def append_predictions(df: DataFrame, path: str) -> None:
    """Append rows as a batch of their own; the directory comes into being
    with the first append."""
    replace_batch(df, path, f"append-{uuid.uuid4().hex}")


def replace_batch(df: DataFrame, path: str, batch_id: int | str) -> None:
    """Write one batch into its own directory, by day. A replayed batch
    overwrites all that its first attempt left, whatever the day of either,
    so no row is logged twice."""
    (
        _dated(df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("created_date")
        .parquet(f"{path}/batch_id={batch_id}")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, or an empty one with the same columns if none exists yet."""
    try:
        return spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_SCHEMA)


def log_path(base: str) -> str:
    return os.path.join(base, "predictions")
