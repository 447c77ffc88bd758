import hashlib
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.operators import joins, splits
from sluice.operators.ranking import rank_within


def digest(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def grouped(spark, n_groups, rows_per_group=3):
    rows = [(g * 1000 + i, f"g{g}", "x") for g in range(n_groups) for i in range(rows_per_group)]
    return spark.createDataFrame(rows, "report_id long, group_id string, label string")


@pytest.mark.parametrize("n_groups", [1, 5, 6, 23])
def test_group_split_takes_the_first_fifth_rounded_up(spark, n_groups):
    got = splits.group_split(grouped(spark, n_groups))
    test = {r.group_id for r in got.filter("split = 'test'").collect()}
    order = sorted((f"g{g}" for g in range(n_groups)), key=digest)
    assert test == set(order[: math.ceil(0.2 * n_groups)])
    assert splits.leaked_groups(got).first().leaked_groups == 0
    assert got.count() == 3 * n_groups


def test_three_way_split(spark):
    got = splits.group_split(grouped(spark, 20), validation_share=0.2)
    order = sorted((f"g{g}" for g in range(20)), key=digest)
    sides = {r.split: set(r.g) for r in got.groupBy("split").agg(F.collect_set("group_id").alias("g")).collect()}
    assert sides == {
        "test": set(order[:4]), "validation": set(order[4:8]), "train": set(order[8:]),
    }


def test_one_group_with_a_third_of_the_rows(spark):
    rows = grouped(spark, 30).unionByName(
        spark.range(10_000, 10_045).select(F.col("id").alias("report_id"), F.lit("g7").alias("group_id"), F.lit("x").alias("label"))
    )
    got = splits.group_split(rows)
    assert got.filter("group_id = 'g7'").select("split").distinct().count() == 1
    assert got.count() == 135


def test_leak_is_found(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "group_id string, split string")
    assert splits.leaked_groups(df).first().leaked_groups == 1


def test_split_report(spark):
    df = spark.createDataFrame(
        [("a", "x", "test"), ("a", "y", "test"), ("b", "x", "train")], "group_id string, label string, split string"
    )
    got = {r.split: (r.n_rows, r.n_groups, r.n_classes) for r in splits.split_report(df).collect()}
    assert got == {"test": (2, 1, 2), "train": (1, 1, 1)}


@pytest.mark.parametrize("n", [1, 7, 40, 100])
def test_subset_is_the_head_of_the_hash_order(spark, n):
    df = spark.range(40).withColumnRenamed("id", "report_id")
    got = {r.report_id for r in splits.subset(df, n).collect()}
    assert got == set(sorted(range(40), key=digest)[:n])


def test_rank_within_equals_the_window(spark):
    df = spark.range(3000).select(
        F.col("id").alias("report_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("l"), F.col("id") % 7)).alias("label"),
    )
    got = rank_within(df, "label", "report_id", 42, "place")
    h = F.md5(F.concat(F.lit("42:"), F.col("report_id").cast("string")))
    plain = df.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(h)))
    assert got.count() == 3000
    assert got.select("report_id", "place").exceptAll(plain.select("report_id", "place")).count() == 0


def test_stratified_folds_are_even(spark):
    df = spark.range(101).select(F.col("id").alias("report_id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("label"))
    sizes = splits.stratified_folds(df).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in sizes if r.label == "a"} == {18}
    assert sorted(r["count"] for r in sizes if r.label == "b") == [2, 2, 2, 2, 3]


def test_group_folds_are_disjoint(spark):
    got = splits.group_folds(grouped(spark, 25), 5)
    assert got.groupBy("group_id").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1


def test_skew_join_equals_join(spark):
    left = spark.range(5000).select(
        F.col("id").alias("report_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 1500).cast("string")).alias("k"),
    )
    right = spark.createDataFrame(
        [("hot", "a"), ("hot", "b"), ("1", "c"), ("4", "d"), ("4", "e"), (None, "f"), ("absent", "g")], "k string, label string"
    )
    assert [r.k for r in joins.hot_keys(left, "k", 0.01).collect()] == ["hot"]
    got = joins.skew_join(left, right, "k", "report_id")
    want = left.join(right, "k")
    assert got.count() == want.count()
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_labelled_corpus_fans_out_and_drops_missing(spark):
    reports = spark.createDataFrame(
        [("r1", "p1", "t"), ("r2", "p2", None), ("r3", "p3", "t"), ("r4", None, "t"), ("r5", "p5", "t")],
        "report_id string, group_id string, text string",
    )
    labels = spark.createDataFrame(
        [("p1", "A"), ("p1", "B"), ("p2", "A"), ("p5", None), ("p9", "A"), (None, "A")], "group_id string, label string"
    )
    got = joins.labelled_corpus(reports, labels)
    assert sorted((r.report_id, r.label) for r in got.collect()) == [("r1", "A"), ("r1", "B")]
    assert [(r.group_id, r.n_labels) for r in joins.duplicate_label_keys(labels).collect()] == [("p1", 2)]


def test_alignment_report(spark):
    truth = spark.createDataFrame([(1,), (2,), (3,)], "report_id long")
    preds = spark.createDataFrame([("m", 1), ("m", 9), ("n", 1), ("n", 2), ("n", 3)], "model string, report_id long")
    got = {r.model: (r.matched, r.only_in_predictions, r.only_in_truth) for r in joins.alignment_report(truth, preds).collect()}
    assert got == {"m": (1, 1, 2), "n": (3, 0, 0)}
