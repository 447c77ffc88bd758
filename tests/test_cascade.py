import dataclasses
import math

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from sluice.operators import routing, scorers
from sluice.operators import windows as win
from sluice.params import CascadeParams
from sluice.plans import cascade
from sluice.plans.training import train
from sluice.session import StageStore

WORDS = {"A": "renal kidney cortex clear", "B": "lung lobe bronchus airway", "C": "skin mole dermis pigment"}
PARAMS = CascadeParams(
    top_k=2, window_tokens=8, window_overlap=2, max_windows=None, min_df=1, stop_words=(), ngram_max=1
)


def report(label, n, other="A"):
    words = WORDS[label].split()
    noise = WORDS[other].split()
    return " ".join(words[i % 4] if i % 5 else noise[i % 4] for i in range(n))


@pytest.fixture(scope="module")
def reports(spark):
    rows = [
        (f"{c}{i}", f"g{c}{i % 5}", report(c, 6 + 3 * i, "ABC"[(i + j) % 3]))
        for j, c in enumerate("ABC") for i in range(10)
    ]
    return spark.createDataFrame(rows, "report_id string, group_id string, text string")


@pytest.fixture(scope="module")
def labels(spark, reports):
    return reports.select("report_id", F.substring("report_id", 1, 1).alias("label"))


@pytest.fixture(scope="module")
def model(spark, reports, labels, tmp_path_factory):
    store = StageStore(spark, str(tmp_path_factory.mktemp("train")))
    return train(reports, labels, PARAMS, store, "report_id").model


@pytest.fixture(scope="module")
def stages(spark, reports, model, tmp_path_factory):
    return cascade.run_stages(reports, model, StageStore(spark, str(tmp_path_factory.mktemp("run"))))


def test_evidence_properties(reports, stages):
    rows = stages.evidence.collect()
    assert all(math.isclose(sum(r.probabilities), 1.0) for r in rows)
    assert all(r.score == max(r.probabilities) and r.top_label in r.candidates for r in rows)
    assert {r.report_id for r in rows} == {r.report_id for r in reports.collect()}
    per_report = {}
    for r in rows:
        per_report.setdefault(r.report_id, []).append(r.chunk_index)
    lengths = {r.report_id: len(r.text.split()) for r in reports.collect()}
    for i, chunks in per_report.items():
        expected = 1 + math.ceil(max(lengths[i] - 8, 0) / 6)
        assert sorted(chunks) == list(range(expected))


def test_decisions_take_the_best_window(stages):
    best = {}
    for r in sorted(stages.evidence.collect(), key=lambda r: r.chunk_index):
        if r.report_id not in best or round(r.score, 6) > round(best[r.report_id].score, 6):
            best[r.report_id] = r
    got = {r.report_id: (r.hybrid_label, r.score) for r in stages.decisions.collect()}
    assert got == {i: (r.top_label, r.score) for i, r in best.items()}


def test_ties_go_to_the_earliest_window_and_first_candidate(spark):
    rows = spark.createDataFrame(
        [("r", 2, ["x", "y"], [0.4, 0.6], "y", 0.6), ("r", 1, ["x", "y"], [0.6, 0.4], "x", 0.6)],
        "report_id string, chunk_index int, candidates array<string>, probabilities array<double>, top_label string, score double",
    )
    assert win.best_window(rows, 6).first().hybrid_label == "x"
    even = rows.select("report_id", "chunk_index", "candidates", F.array(F.lit(0.5), F.lit(0.5)).alias("probabilities"))
    assert {r.top_label for r in win.best_candidate(even, 6).collect()} == {"x"}


def test_report_without_windows_gets_candidate_one(spark):
    candidates = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"])], "report_id string, candidates array<string>")
    best = spark.createDataFrame([("a", "y", 0.9)], "report_id string, hybrid_label string, score double")
    got = {r.report_id: (r.hybrid_label, r.score) for r in win.with_defaults(candidates, best).collect()}
    assert got == {"a": ("y", 0.9), "b": ("y", -1.0)}


def test_own_candidates_and_own_window_scores(reports, model, stages):
    own = reports.select("report_id", F.array(F.lit("C"), F.lit("B")).alias("candidates"))
    evidence = win.window_evidence(win.unit_scores(reports, model), model, own)
    assert {tuple(r.candidates) for r in evidence.select("candidates").distinct().collect()} == {("C", "B")}
    assert evidence.count() == stages.evidence.count()
    windows = win.report_windows(reports, PARAMS)
    pairs = win.window_candidates(windows, own)
    assert pairs.count() == 2 * windows.count()
    scored = pairs.filter("label = 'B'").select("report_id", "chunk_index", "label", F.lit(1.0).alias("raw_score"))
    again = win.evidence_from_rows(scored, own, 1.0, 6)
    assert {(r.top_label, round(r.score, 6)) for r in again.collect()} == {("B", round(math.e / (1 + math.e), 6))}


def test_explain_lists_every_window_in_order(reports, stages):
    one = reports.filter("report_id = 'A9'")
    told = win.explain(one, stages.evidence, PARAMS).collect()
    assert len(told) == 1
    chunks = told[0].chunk_evidence
    assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and len(chunks) > 2
    assert chunks[0].chunk_text == " ".join(one.first().text.split()[:8])


def decisions(spark):
    return spark.createDataFrame(
        [("kept", 0.6), ("near", 0.59996), ("low", 0.1), ("none", -1.0)], "report_id string, score double"
    ).select("report_id", F.array(F.lit("A"), F.lit("B")).alias("candidates"), F.lit("A").alias("hybrid_label"), "score")


def test_threshold_is_inclusive_and_score_rounded_after(spark, store):
    kept, low = routing.split_by_threshold(decisions(spark), 0.6)
    assert [r.report_id for r in kept.collect()] == ["kept"]

    def scorer(asked, attempt):
        return asked.select("report_id", F.lit("b x").alias("raw"))

    answers = routing.fallback_answers(low, scorer, 1, store)
    got = {r.report_id: r for r in routing.response_rows(routing.routed_rows(kept, low, answers, "big"), "run").collect()}
    assert len(got) == 4
    assert (got["near"].routing_score, got["near"].routed_to, got["near"].prediction) == (0.6, "big", "B")
    assert got["kept"].routed_to == "hybrid" and got["kept"].reliability == "high"


@pytest.mark.parametrize("t", [-0.1, 1.1])
def test_threshold_must_be_a_share(spark, t):
    with pytest.raises(ValueError):
        routing.split_by_threshold(decisions(spark), t)
    with pytest.raises(ValueError):
        routing.threshold_change(decisions(spark), 0.6, t)


def test_retry_only_asks_the_invalid_again(spark, store):
    low = decisions(spark)
    asked_counts = []

    def scorer(asked, attempt):
        asked_counts.append(asked.count())
        second = F.when(F.lit(attempt) == 1, "B").otherwise("?")
        raw = F.when(F.col("report_id") == "kept", "a").when(F.col("report_id") == "near", second).otherwise("B.")
        return asked.filter("report_id <> 'none'").select("report_id", raw.alias("raw"))

    got = {r.report_id: (r.answer, r.was_valid, r.attempts) for r in routing.fallback_answers(low, scorer, 1, store).collect()}
    assert got == {
        "kept": ("A", True, 1), "near": ("B", True, 2), "low": ("A", False, 2), "none": ("A", False, 2),
    }
    assert asked_counts == [4, 2]


def test_unknown_backend():
    with pytest.raises(ValueError):
        scorers.get_backend("missing")


def test_python_scorer_sees_low_rows_only(spark, model, reports, stages, store):
    seen = spark.sparkContext.accumulator(0)

    def answer(text, codes, attempt):
        seen.add(1)
        return codes[-1].lower()

    scorers.register_backend("last", lambda context: scorers.python_scorer(answer))
    threshold = sorted(r.score for r in stages.decisions.collect())[5]
    routed = cascade.route(stages, model, store, "last", threshold, reports).collect()
    low = [r for r in routed if r.routed_to == "last"]
    assert seen.value == len(low) == sum(r.score < threshold for r in routed) > 0
    assert all(r.prediction == r.candidates[-1] for r in low)
    with pytest.raises(ValueError):
        cascade.route(stages, model, store, "last", threshold)


def test_rerouting_extremes(spark, model, stages, tmp_path):
    all_hybrid = cascade.route(stages, model, StageStore(spark, str(tmp_path)), threshold=0.0)
    assert {r.routed_to for r in all_hybrid.collect()} == {"hybrid"}
    all_low = cascade.route(stages, model, StageStore(spark, str(tmp_path)), threshold=1.0)
    assert {r.routed_to for r in all_low.filter("score < 1").collect()} <= {"window_mean"}
    change = routing.threshold_change(stages.decisions, 0.0, 1.0).first()
    assert change.to_fallback == stages.decisions.filter("score < 1").count() and change.to_hybrid == 0


def test_batch_keeps_bad_rows_apart(spark, model, tmp_path):
    rows = spark.createDataFrame(
        [("ok", "lung lobe bronchus airway lung"), ("short", "lung"), ("blank", " " * 30), ("null", None)],
        "report_id string, text string",
    )
    done = cascade.classify(rows, model, StageStore(spark, str(tmp_path)), run_id="r1")
    assert {r.report_id: r.reason for r in done.rejects.collect()} == {
        "short": "too_short", "blank": "blank", "null": "missing",
    }
    result = done.results.collect()
    assert [(r.report_id, r.prediction) for r in result] == [("ok", "B")]
    assert tuple(cascade.batch_totals(done).first()) == (4, 1, 3)
    assert cascade.throughput(done)["reports"] == 1
    log = cascade.log_rows(done, rows).first()
    assert log.id == result[0].prediction_id and log.report_text.startswith("lung") and log.latency_ms >= 0
    loose = cascade.classify(rows, model, StageStore(spark, str(tmp_path)), validate=False)
    assert tuple(cascade.batch_totals(loose).first()) == (4, 3, 1)


def test_text_without_known_words_still_gets_an_answer(spark, model, tmp_path):
    rows = spark.createDataFrame([("odd", "zzzz yyyy xxxx wwww vvvv uuuu")], "report_id string, text string")
    got = cascade.classify(rows, model, StageStore(spark, str(tmp_path))).results.first()
    assert got.top_k_candidates == ["A", "B"] and got.routing_score == 0.5 and got.prediction == "A"


def test_window_cap_is_a_parameter(spark, reports, model):
    capped = dataclasses.replace(model, params=dataclasses.replace(PARAMS, max_windows=2))
    full, cut = (win.window_evidence(win.unit_scores(reports, m), m) for m in (model, capped))
    assert cut.agg(F.max("chunk_index")).first()[0] == 1 < full.agg(F.max("chunk_index")).first()[0]


def test_classify_then_route_on_one_store(model, reports, store):
    done = cascade.classify(reports, model, store)
    n = done.results.count()
    assert cascade.route(done.stages, model, store, threshold=0.0).count() == n
    assert cascade.route(done.stages, model, store, threshold=1.0).count() == n


def test_rows_without_a_score_are_low(spark):
    rows = spark.createDataFrame([("a", None), ("b", 0.9)], "report_id string, score double")
    kept, low = routing.split_by_threshold(rows, 0.6)
    assert [r.report_id for r in kept.collect()] == ["b"] and [r.report_id for r in low.collect()] == ["a"]


def test_failing_rows_are_rejected_or_take_candidate_one(spark, model, reports, store):
    def answer(text, codes, attempt):
        if len(text) % 2:
            raise ValueError("odd")
        return codes[-1]

    scorers.register_backend("odd", lambda context: scorers.python_scorer(answer))
    strict = dataclasses.replace(model, params=dataclasses.replace(PARAMS, threshold=1.0))
    n, odd = reports.count(), reports.filter("length(text) % 2 = 1").count()
    done = cascade.classify(reports, strict, store, "odd", validate=False)
    low = done.rejects.collect()
    assert {r.reason for r in low} <= {"scorer: ValueError: odd"} and 0 < len(low) <= odd
    assert done.results.count() + len(low) == n
    kept = cascade.classify(reports, strict, store, "odd", validate=False, on_error="first_candidate")
    assert kept.results.count() == n
    failed = kept.results.filter("reliability = 'low'").collect()
    assert {r.report_id for r in failed} == {r.report_id for r in low}
    assert all(r.prediction == r.top_k_candidates[0] for r in failed)


def test_model_is_built_once_per_task(spark, model, reports, store):
    built, rows = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        built.add(1)

        def answer(batch, attempt):
            rows.add(len(batch))
            return [c[0] for c in batch["candidates"]]

        return answer

    low = reports.withColumn("candidates", F.array(F.lit("A"), F.lit("B"))).coalesce(1)
    assert scorers.batch_scorer(make)(low, 0).filter("raw = 'A'").count() == reports.count()
    assert built.value == 1 and rows.value == reports.count()


def test_own_window_scorer_in_the_cascade(reports, model, store):
    def scorer(windows):
        scored = F.transform("candidates", lambda c: F.struct(c.alias("label"), (c == "B").cast("double").alias("raw_score")))
        rows = windows.filter("report_id <> 'A9'").select("report_id", "chunk_index", scored.alias("s"))
        return rows.select("report_id", "chunk_index", F.inline("s"))

    done = cascade.classify(reports, model, store, validate=False, window_scorer=scorer)
    got = {r.report_id: r for r in done.results.collect()}
    assert len(got) == reports.count()
    for i, r in got.items():
        assert r.prediction == ("B" if "B" in r.top_k_candidates and i != "A9" else r.top_k_candidates[0])
    assert got["A9"].routing_score == -1.0


def test_stage_rows_come_from_the_writing_jobs(spark, reports, model, store):
    done = cascade.classify(reports, model, store)
    report = {s["stage"]: s for s in cascade.stage_report(done)}
    assert set(report) == {"evidence", "decisions", "routing"}
    assert report["evidence"]["rows"] == done.stages.evidence.count()
    assert report["decisions"]["rows"] == done.stages.decisions.count()
    assert report["routing"]["rows"] == cascade.throughput(done)["reports"] == done.results.count()
    assert all(s["seconds"] > 0 and s["rows_per_second"] > 0 for s in report.values())


def test_stage_rows_of_an_empty_table(spark, reports, model, store):
    done = cascade.classify(reports.limit(0), model, store)
    assert [s["rows"] for s in cascade.stage_report(done)] == [0, 0, 0]
    assert cascade.throughput(done)["reports"] == 0


@pytest.mark.parametrize("most", [cascade.BROADCAST_IDS, 0])
def test_only_reports_that_share_an_id_are_shuffled(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(cascade, "BROADCAST_IDS", most)
    rows = [("a", "lung"), ("b", "lobe"), ("b", "lobe"), ("c", "skin"), ("c", "mole"), (None, "x"), (None, "y")]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "report_id string, text string").write.parquet(path)
    good = spark.read.parquet(path)
    checked = good.select("report_id", F.lit(None).cast("string").alias("reason"), F.xxhash64("text").alias("digest"))
    repeated = cascade.repeated_ids(checked)
    assert {(r.report_id, r.copies, r.same_text) for r in repeated.collect()} == {
        ("b", 2, True), ("c", 2, False), (None, 2, False)
    }
    texts = cascade.one_each(good, repeated, 3)
    got = sorted(((r.report_id or "", r.text) for r in texts.collect()))
    assert got[0] in [("", "x"), ("", "y")] and got[1:] == [("a", "lung"), ("b", "lobe")]
    assert ("Union" in plan_of(texts)) == (most > 0)


def test_repeats_and_refusals_are_told_from_short_rows(spark, reports, model, tmp_path):
    """What is refused, repeated or ambiguous is found without the texts."""
    store = StageStore(spark, str(tmp_path / "run"))
    path = str(tmp_path / "reports")
    again = reports.filter("report_id in ('A1', 'B2')")
    other = reports.filter("report_id = 'C3'").withColumn("text", F.concat("text", F.lit(" and more")))
    short = spark.createDataFrame([("S1", "gS", "tiny"), ("S2", "gS", None)], reports.schema)
    reports.unionByName(again).unionByName(other).unionByName(short).write.parquet(path)
    done = cascade.classify(spark.read.parquet(path), model, store)
    told = sorted((r.report_id, r.reason) for r in done.rejects.collect())
    assert told == [("C3", "ambiguous_id")] * 2 + [("S1", "too_short"), ("S2", "missing")]
    assert path not in "".join(done.rejects.inputFiles())
    counts = {r.report_id: r["count"] for r in done.results.groupBy("report_id").count().collect()}
    assert counts["A1"] == counts["B2"] == 2 and "C3" not in counts
    assert len(counts) == reports.filter("length(text) >= 20").count() - 1
