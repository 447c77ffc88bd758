"""The driver contract: queries and their SQL counterparts."""

import duckdb
import pytest

import __spark_entry__ as contract
import check

QUICK = (
    "group_split", "validation_split", "group_label_join", "stratified_folds", "request_check",
    "focused_text", "validated_answers", "report_ngrams", "term_statistics", "vocabulary_cap",
    "token_windows", "window_coverage", "fallback_retry", "log_metrics", "log_metrics_by",
    "log_metrics_empty", "model_comparison", "subset_comparison", "model_ranking",
    "threshold_sweep", "routed_accuracy", "classify_reports", "stream_sliding_metrics",
)


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def test_every_counterpart_has_a_query():
    sqls, queries = contract.oracle_sql(), contract.queries()
    assert set(sqls) <= set(queries)
    # Of the library's own queries, all have one.
    assert set(queries) - set(sqls) <= {q for q in queries if q.startswith("op") or q == "pipeline"}


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, sf, name):
    line = check.compare(spark, con, sf, name, contract.oracle_sql()[name])
    assert line.startswith("ok"), line


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "report_id" and df.count() > 0
