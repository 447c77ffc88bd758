"""What the physical plans must and must not contain."""

import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from sluice.catalog import fixtures as fx
from sluice.operators import joins, metrics, splits
from sluice.operators import windows as win
from sluice.operators.candidates import report_scores
from sluice.plans import cascade
from sluice.session import StageStore
from sluice.sources import prediction_log
from sluice.sources.evidence_lookup import MOST_IDS, save_evidence
from sluice.sources.reports import save_bucketed


@pytest.fixture(scope="module")
def trained(spark, sf):
    return fx.training(spark, sf)


@pytest.fixture
def plain_reports(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.col("source").alias("group_id"), "text")


def check_clean(plan):
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad


def test_scoring_moves_no_text(spark, trained, plain_reports):
    plan = plan_of(report_scores(plain_reports, trained.model))
    check_clean(plan)
    assert plan.count(") Exchange") // 2 <= 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    exchanged = plan[plan.rindex("Exchange\nInput"):].split("\n")[1]
    assert "text" not in exchanged and "terms" not in exchanged
    check_clean(plan_of(win.window_evidence(win.unit_scores(plain_reports, trained.model), trained.model)))


def test_split_moves_no_rows(plain_reports):
    corpus = plain_reports.withColumn("label", F.lit("x"))
    plan = plan_of(splits.group_split(corpus))
    check_clean(plan)
    main = plan.split("===== Subqueries")[0]
    assert "Exchange" not in main


def test_default_route_has_no_python_and_no_cross_join(spark, trained, plain_reports, tmp_path):
    store = StageStore(spark, str(tmp_path))
    stages = cascade.run_stages(plain_reports, trained.model, store)
    check_clean(plan_of(cascade.route(stages, trained.model, store)))


def test_metrics_read_only_their_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.range(3).select(
        F.col("id").cast("string"), F.lit("t").alias("report_text"), F.lit("A").alias("prediction"), F.lit("a").alias("prediction_label"),
        F.lit(0.5).alias("routing_score"), F.lit("hybrid").alias("routed_to"), F.lit("high").alias("reliability"),
        F.array(F.lit("A")).alias("top_k_candidates"), F.lit(3).alias("latency_ms"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    prediction_log.append_predictions(row, path)
    log = prediction_log.read_log(spark, path)
    plan = plan_of(metrics.log_metrics(log))
    check_clean(plan)
    assert "report_text" not in plan
    filtered = plan_of(metrics.log_metrics(log.filter("routed_to = 'hybrid' and created_date = date'2024-01-01'")))
    assert "EqualTo(routed_to,hybrid)" in filtered and "PartitionFilters: [isnotnull(created_date" in filtered


def test_bucketed_tables_join_in_place(spark, plain_reports):
    labels = plain_reports.select("report_id", F.lit("x").alias("label"))
    save_bucketed(plain_reports, "bucketed_reports", "report_id", 4)
    save_bucketed(labels, "bucketed_labels", "report_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = joins.labelled_corpus(spark.table("bucketed_reports"), spark.table("bucketed_labels"), "report_id")
        assert both.count() == plain_reports.count()
        assert "Exchange" not in plan_of(both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_reports")
        spark.sql("DROP TABLE bucketed_labels")


def test_evidence_of_few_ids_opens_few_buckets(spark, trained, plain_reports, tmp_path):
    store = StageStore(spark, str(tmp_path))
    stages = cascade.run_stages(plain_reports, trained.model, store)
    params = trained.model.params
    stored = save_evidence(plain_reports, stages.evidence, "kept_evidence", 64, str(tmp_path / "kept"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        every = {r.report_id: r.chunk_evidence for r in win.explain(plain_reports, stages.evidence, params).collect()}
        ids = sorted(every)[:5]
        told = stored.of([*ids, ids[0], None, -7], params)
        plan = plan_of(told)
        check_clean(plan)
        assert "Exchange" not in plan
        # Six ids, stored or not: at most six of the 64 buckets of each table.
        opened = [int(n) for n in re.findall(r"SelectedBucketsCount: (\d+) out of 64", plan)]
        assert len(opened) == 2 and max(opened) <= 6
        assert {r.report_id: r.chunk_evidence for r in told.collect()} == {i: every[i] for i in ids}
        assert stored.of([], params).count() == 0 == stored.of([None, -7], params).count()
        assert {r.report_id for r in stored.of(list(every), params).collect()} == set(every)
        with pytest.raises(ValueError):
            stored.of(range(MOST_IDS + 1), params)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE kept_evidence_texts")
        spark.sql("DROP TABLE kept_evidence_evidence")
