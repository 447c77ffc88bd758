"""Report and label tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import group_of

REPORTS_CSV = T.StructType([
    T.StructField("patient_filename", T.StringType()),
    T.StructField("text", T.StringType()),
])
LABELS_CSV = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("cancer_type", T.StringType()),
])

# Spellings the reference's CSV reader takes for missing.
NULL_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # Reports hold line breaks, so a record may span lines. Such files cannot
    # be split: ship many files, or convert once with save_bucketed().
    # Columns are taken by their header name, as strings; others are ignored.
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select([
        F.when(~F.col(f.name).isin(*NULL_SPELLINGS), F.col(f.name)).alias(f.name)
        for f in schema
    ])


def read_reports_csv(spark: SparkSession, path: str) -> DataFrame:
    """report_id, group_id, text; the group is the file name up to the dot."""
    raw = _read_csv(spark, path, REPORTS_CSV)
    return raw.select(
        F.col("patient_filename").alias("report_id"),
        group_of(F.col("patient_filename")).alias("group_id"),
        "text",
    )


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """group_id, label."""
    raw = _read_csv(spark, path, LABELS_CSV)
    return raw.select(
        F.col("patient_id").alias("group_id"), F.col("cancer_type").alias("label")
    )


def read_reports(
    spark: SparkSession, path: str, report_id: str, group_id: str, text: str = "text"
) -> DataFrame:
    """Any Parquet table seen as report_id, group_id, text. A missing path
    fails here, before any job starts."""
    return spark.read.parquet(path).select(
        F.col(report_id).alias("report_id"),
        F.col(group_id).alias("group_id"),
        F.col(text).alias("text"),
    )


def spread_small(df: DataFrame) -> DataFrame:
    """A table that comes in fewer input splits than the cluster has cores is
    dealt in turn over all of them before the text work starts; the plan above
    is the one a large table gets, with all its exchanges. Splits are limited in
    size (spark.sql.files.maxPartitionBytes), so what moves here is at most
    that size times the cores; tables with more splits stay where they are.
    Pass a plain scan: its splits are known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def save_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, then: Sequence[str] = (), path: str | None = None
) -> None:
    """Store a table bucketed by its join key and sorted by it (and `then`):
    later joins and groupings on the key read the buckets in place and move no
    text, and a filter on a few keys opens only their buckets, in which row
    groups are skipped by their bounds and Bloom filters. With a path the files
    lie there and the catalog only names them."""
    writer = (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .bucketBy(buckets, key)
        .sortBy(key, *then)
    )
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
