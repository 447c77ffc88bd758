"""The given tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.params import CascadeParams
from sluice.plans.training import Training, train
from sluice.session import StageStore
from sluice.sources.reports import read_reports, spread_small

PARAMS = CascadeParams()
BASELINE = "base"
# Fixed test anchors that occur in the given documents.
ANCHORS = ("license", "the ", "de ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, group_id, text."""
    return spread_small(
        read_reports(spark, f"{sf_dir}/documents.parquet", "doc_id", "source")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, label: language and quality, up to 8 classes."""
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return langs.join(marks, "doc_id").select(
        F.col("doc_id").alias("report_id"),
        F.concat(F.upper("lang"), F.lit("-"), F.col("quality").cast("string")).alias("label"),
    )


def training(
    spark: SparkSession,
    sf_dir: str,
    params: CascadeParams = PARAMS,
    validation_share: float = 0.0,
) -> Training:
    return train(
        reports(spark, sf_dir),
        labels(spark, sf_dir),
        params,
        StageStore(spark),
        "report_id",
        validation_share,
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the role of the prediction log."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return as_log(table(spark, sf_dir, "events"))


def as_log(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(kind.isin("click", "view"), "hybrid").otherwise(kind).alias("routed_to"),
        F.when(kind == "error", "low").otherwise("high").alias("reliability"),
        ((F.col("event_id") * 37 % 100) / F.lit(100.0)).alias("routing_score"),
        F.col("value").cast("int").alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, y_true, confidence, candidates."""
    lang = F.col("lang")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("report_id"),
        lang.alias("y_true"),
        ((F.col("doc_id") * 37 % 100) / F.lit(100.0)).alias("confidence"),
        F.array(F.lit("en"), F.lit("fr"), F.lit("de")).alias("candidates"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, report_id, pred of three models."""
    docs = table(spark, sf_dir, "documents")
    made = F.array(
        F.struct(
            F.lit("base").alias("model"),
            F.when(F.col("doc_id") % 10 < 8, F.col("lang")).otherwise("en").alias("pred"),
        ),
        F.struct(
            F.lit("model_a").alias("model"),
            F.when(F.col("doc_id") % 7 < 6, F.col("lang")).otherwise("fr").alias("pred"),
        ),
        F.struct(F.lit("model_b").alias("model"), F.lit("en").alias("pred")),
    )
    return docs.select(F.col("doc_id").alias("report_id"), F.explode(made).alias("m")).select(
        "m.model", "report_id", "m.pred"
    )


def registry(spark: SparkSession) -> DataFrame:
    """model_b stands for a paid model, model_c was never run."""
    return spark.createDataFrame(
        [("base", True, True, 0), ("model_a", False, True, 1),
         ("model_b", False, False, 2), ("model_c", False, True, 3)],
        "model string, is_baseline boolean, is_local boolean, registry_order int",
    )
