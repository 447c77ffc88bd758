"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001  # a hot key holds more than this share of the left rows
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys above a share of the rows: at most 1 / share of them, whatever
    the size of the table, so the result may be broadcast."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.filter(F.col("n") > total * F.lit(share)).select(key)


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join whose hot left keys are cut into SALTS parts by `spread`
    (a column that differs from row to row); only the right rows of hot keys
    are repeated once per part. Other keys join as usual. Exact: every pair
    meets in exactly one part."""
    hot = F.broadcast(hot_keys(left, key).withColumn("_hot", F.lit(True)))
    salted_left = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_right = right.join(hot, key, "left").withColumn("_salt", F.explode(parts))
    return salted_left.drop("_hot").join(salted_right.drop("_hot"), [key, "_salt"]).drop("_salt")


def labelled_corpus(reports: DataFrame, labels: DataFrame, key: str = "group_id") -> DataFrame:
    """Reports with their labels. A label key that occurs twice multiplies
    its reports, as an inner equi-join does; rows without text or label go.
    Groups may be of any size and are spread; a report id occurs once among
    the reports, so a join on it needs no spreading."""
    have_text = reports.filter(F.col("text").isNotNull())
    have_label = labels.filter(F.col("label").isNotNull())
    if key == "report_id":
        return have_text.join(have_label, key)
    return skew_join(have_text, have_label, key, spread="report_id")


def duplicate_label_keys(labels: DataFrame, key: str = "group_id") -> DataFrame:
    """Label keys that would multiply reports, with their row counts."""
    counts = labels.groupBy(key).agg(F.count(F.lit(1)).alias("n_labels"))
    return counts.filter(F.col("n_labels") > 1)


def align(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Truth and predictions side by side, matched by report id."""
    return truth.join(preds, "report_id")


def alignment_report(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Matched and unmatched report ids of both sides, per model. Ids are
    counted by presence flags in one grouping, not by an outer join."""
    flags = preds.groupBy("model", "report_id").agg(F.count(F.lit(1)).alias("n"))
    known = truth.select("report_id", F.lit(1).alias("_known"))
    per_model = (
        flags.join(known, "report_id", "left")
        .groupBy("model")
        .agg(
            F.count("_known").alias("matched"),
            F.count_if(F.col("_known").isNull()).alias("only_in_predictions"),
        )
    )
    total = truth.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_model.withColumn("only_in_truth", total - F.col("matched"))
