"""Evaluation predictions, one partition per model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def predictions_schema(id_type: str) -> str:
    return f"report_id {id_type}, pred string, model string"


def read_predictions(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """Stored predictions of all models; empty, but typed, when none are."""
    schema = predictions_schema(id_type)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert_predictions(df: DataFrame, path: str) -> None:
    """Replace the predictions of the models in df, keep all other models."""
    (
        df.select("report_id", "pred", "model")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def pending(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of (model, report_id) that have no stored prediction yet."""
    done = stored.filter(F.col("pred").isNotNull()).select("model", "report_id")
    return wanted.join(done, ["model", "report_id"], "left_anti")
