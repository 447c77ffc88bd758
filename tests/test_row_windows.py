"""Windows by prefix sums: the rows that exploded windows give, and the plan."""

import random
from dataclasses import replace

import pytest
from conftest import plan_of

from sluice.operators import row_windows as rw
from sluice.operators import windows as win
from sluice.operators.centroids import CentroidModel, fit_centroids
from sluice.params import CascadeParams
from sluice.plans.cascade import run_stages
from sluice.session import StageStore

P = CascadeParams(window_tokens=12, window_overlap=5, min_df=1, top_k=2, stop_words=("the", "of"))


def texts():
    rng = random.Random(4)
    words = ["renal", "cortex", "lung", "lobe", "skin", "the", "of", "tissue", "a1", "Überall", "unseen"]
    rows = [(i, " ".join(rng.choice(words[:-1]) for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, "the of the"), (103, "unseen words only here"), (104, "lung"), (105, "x y z")]
    rows += [(106, " ".join(words * 400)), (107, "renal cortex " * 6), (108, "renal the cortex of lung, lobe")]
    return rows


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(texts(), "report_id int, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def model(spark, reports, tmp_path_factory):
    from pyspark.sql import functions as F

    store = StageStore(spark, str(tmp_path_factory.mktemp("rows")))
    label = F.element_at(F.array(*[F.lit(x) for x in "abc"]), F.pmod("report_id", F.lit(3)) + 1)
    return fit_centroids(reports.filter("report_id < 60").withColumn("label", label), P, store)


def rows_of(evidence):
    return sorted(
        (r.report_id, r.chunk_index, r.candidates, [round(p, 7) for p in r.probabilities], r.top_label)
        for r in evidence.collect()
    )


@pytest.mark.parametrize("changes", [{}, {"ngram_max": 1}, {"max_windows": 2}, {"window_overlap": 0}, {"stop_words": ()}])
def test_same_rows_as_exploded_windows(reports, model, changes):
    own = CentroidModel(replace(P, **changes), model.vocabulary, model.vectorizer, model.weights)
    want = win.window_evidence(win.unit_scores(reports, own), own)
    assert rows_of(rw.row_evidence(reports, own)) == rows_of(want)


def test_candidates_of_a_callers_own(spark, reports, model):
    made = [(i, ["b", "unknown"] if i % 2 else ["c", "a", "b"]) for i in range(0, 108, 3)]
    own = spark.createDataFrame(made, "report_id int, candidates array<string>")
    want = win.window_evidence(win.unit_scores(reports, model), model, own)
    assert rows_of(rw.row_evidence(reports, model, own)) == rows_of(want)


def test_small_pieces_give_the_same(reports, model, monkeypatch):
    want = rows_of(rw.row_evidence(reports, model))
    monkeypatch.setattr(rw, "TOKENS_AT_ONCE", 10)
    assert rows_of(rw.row_evidence(reports, model)) == want


def test_no_exchange_and_no_exploded_windows(spark, reports, model, tmp_path):
    path = str(tmp_path / "reports")
    reports.write.parquet(path)
    plain = spark.read.parquet(path)
    plan = plan_of(rw.row_evidence(plain, model))
    assert "Exchange" not in plan and plan.count("MapInArrow") >= 1 and "Join" not in plan
    assert plan.count("Scan parquet") == 2  # tree and details of one scan


def test_large_models_score_by_windows(reports, model, store, monkeypatch):
    want = rows_of(run_stages(reports, model, store).evidence)
    monkeypatch.setattr(rw, "MODEL_BYTES", 0)
    assert rows_of(run_stages(reports, model, store).evidence) == want


def test_no_reports(spark, model):
    assert rw.row_evidence(spark.createDataFrame([], "report_id int, text string"), model).count() == 0


def test_texts_are_scored_without_finding_words_in_the_plan(spark, model):
    """A text goes to Python whole, not as one value for each word."""
    plain = spark.createDataFrame([(1, "red apple")], "report_id int, text string")
    assert "regexp_extract_all" not in plan_of(rw.row_evidence(plain, model))
