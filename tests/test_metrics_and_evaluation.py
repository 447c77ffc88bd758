import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from sluice.operators import evaluation as ev
from sluice.operators import metrics

LOG = "id string, routed_to string, reliability string, latency_ms int, routing_score double, created_at timestamp"


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    values = [("a", rng.randint(0, 500)) for _ in range(3000)]
    values += [("b", 7)] * 1500 + [("b", i) for i in range(700)] + [("c", 1), ("c", 2), ("d", 5), ("d", None)]
    df = spark.createDataFrame(values, "k string, latency_ms int").repartition(7)
    got = {r.k: (r.p50_latency_ms, r.p95_latency_ms) for r in metrics.latency_percentiles(df, ["k"]).collect()}
    for key in "abcd":
        own = [v for k, v in values if k == key and v is not None]
        assert got[key] == pytest.approx(tuple(np.percentile(own, [50, 95])), abs=0.006)


def test_log_is_scanned_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("1", "hybrid", "high", 10, 0.9, None)], LOG).write.parquet(path)
    for table in (metrics.log_metrics, metrics.log_metrics_by):
        plan = plan_of(table(spark.read.parquet(path))).split("== Initial Plan ==")[-1]
        assert plan.count("Scan parquet") == 2  # once in the tree, once in its details


def test_log_metrics(spark):
    rows = [
        ("1", "hybrid", "high", 10, 0.9, None), ("2", "hybrid", "high", 20, 0.8, None),
        ("3", "remote", "low", 30, 0.3, None),
    ]
    got = metrics.log_metrics(spark.createDataFrame(rows, LOG)).first().asDict()
    assert got == {
        "total_requests": 3, "routed_to_hybrid": 2, "routed_to_fallback": 1, "low_reliability_count": 1,
        "fallback_rate": 0.3333, "low_reliability_rate": 0.3333, "avg_latency_ms": 20.0,
        "avg_routing_score": 0.6667, "p50_latency_ms": 20.0, "p95_latency_ms": 29.0,
    }


def test_empty_log_gives_zeros(spark):
    got = metrics.log_metrics(spark.createDataFrame([], LOG)).collect()
    assert len(got) == 1 and set(got[0]) == {0}


PREDS = "model string, report_id long, pred string"
TRUTH = "report_id long, y_true string, confidence double"
REGISTRY = "model string, is_baseline boolean, is_local boolean, registry_order int"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    truth = [(i, rng.choice("abc"), round(rng.random(), 3)) for i in range(300)]
    preds = []
    for model, skill in (("base", 0.6), ("m1", 0.8), ("m2", 0.3)):
        for i, y, _ in truth:
            preds.append((model, i, y if rng.random() < skill else rng.choice("abcd")))
    return truth, preds, spark.createDataFrame(truth, TRUTH), spark.createDataFrame(preds, PREDS)


def f1_by_hand(pairs):
    labels = {x for pair in pairs for x in pair}
    scores, weighted = [], 0
    for c in labels:
        tp = sum(y == p == c for y, p in pairs)
        total = sum((y == c) + (p == c) for y, p in pairs)
        scores.append(2 * tp / total)
        weighted += scores[-1] * sum(y == c for y, _ in pairs)
    return sum(scores) / len(scores), weighted / len(pairs)


def pairs_of(data, model, keep=lambda c: True):
    truth, preds, _, _ = data
    known = {i: (y, c) for i, y, c in truth}
    return [(known[i][0], p) for m, i, p in preds if m == model and keep(known[i][1])]


def test_comparison(data):
    counts = ev.evaluation_counts(data[2], data[3], "base", 0.6)
    got = {(r.model, r.band): r for r in ev.comparison(counts, "base").collect()}
    assert len(got) == 9
    for (model, band), r in got.items():
        keep = {"ALL": lambda c: True, "HIGH": lambda c: c >= 0.6, "LOW": lambda c: c < 0.6}[band]
        pairs, base = pairs_of(data, model, keep), pairs_of(data, "base", keep)
        accuracy = sum(y == p for y, p in pairs) / len(pairs)
        assert (r.n, r.share, r.accuracy) == (len(pairs), len(pairs) / 300, pytest.approx(accuracy))
        assert r.macro_f1 == pytest.approx(f1_by_hand(pairs)[0])
        assert r.delta == pytest.approx(accuracy - sum(y == p for y, p in base) / len(base))


def test_f1_and_confusion(data):
    counts = ev.evaluation_counts(data[2], data[3], "base", 0.6)
    for r in ev.f1_scores(counts, "model").collect():
        assert (r.macro_f1, r.weighted_f1) == pytest.approx(f1_by_hand(pairs_of(data, r.model)))
    cells = {(r.y_true, r.pred): r.n for r in ev.confusion(counts).filter("model = 'm1'").collect()}
    assert cells == Counter(pairs_of(data, "m1"))
    wide = ev.confusion_pivot(counts, list("abcd")).filter("model = 'm1' and y_true = 'a'").first()
    assert [wide[c] for c in "abcd"] == [cells.get(("a", c), 0) for c in "abcd"]


def test_labels_on_one_side_only_and_no_hit(spark):
    truth = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.9)], TRUTH)
    preds = spark.createDataFrame([("base", 1, "x"), ("base", 2, None)], PREDS)
    counts = ev.evaluation_counts(truth, preds, "base", 0.6)
    rows = {r.label: r for r in ev.class_scores_table(counts, "model").collect()}
    assert set(rows) == {"a", "b", "x"} and all(r.f1 == r.precision == r.recall == 0 for r in rows.values())
    assert {r.band for r in ev.comparison(counts, "base").collect()} == {"ALL", "HIGH"}


def test_recovery_adds_up(data):
    truth, preds, t, p = data
    known = {i: (y, c) for i, y, c in truth}
    base = {i: q for m, i, q in preds if m == "base"}
    for r in ev.recovery(ev.evaluation_counts(t, p, "base", 0.6), "base").collect():
        low = [(known[i][0], base[i], q) for m, i, q in preds if m == r.model and known[i][1] < 0.6]
        assert r.recoveries == sum(b != y and q == y for y, b, q in low)
        assert r.regressions == sum(b == y and q != y for y, b, q in low)
        assert r.both_wrong == sum(b != y and q != y for y, b, q in low)
        assert r.net_gain == r.recoveries - r.regressions


def test_subset_uses_its_own_reports(data, store):
    truth, preds, t, p = data
    some = p.filter("model = 'm1' and report_id % 4 = 0").withColumn("model", F.lit("s"))
    got = {r.band: r for r in ev.subset_comparison(t, p.unionByName(some), "s", "base", 0.6, store).collect()}
    known = {i: (y, c) for i, y, c in truth}
    mine = {i: q for m, i, q in preds if m == "m1" and i % 4 == 0}
    base = {i: q for m, i, q in preds if m == "base" and i % 4 == 0}
    for band, ids in (("ALL", list(mine)), ("LOW", [i for i in mine if known[i][1] < 0.6])):
        r = got[band]
        assert r.n == len(ids)
        assert r.base_accuracy == pytest.approx(sum(base[i] == known[i][0] for i in ids) / len(ids))
        assert r.accuracy == pytest.approx(sum(mine[i] == known[i][0] for i in ids) / len(ids))
        assert r.recoveries == sum(base[i] != known[i][0] == mine[i] for i in ids)


def ranked(spark, hits):
    """Ten LOW rows; a model is right on the first `hits` of them."""
    truth = spark.createDataFrame([(i, "a", 0.1) for i in range(10)], TRUTH)
    preds = [(m, i, "a" if i < n else "b") for m, n in hits.items() for i in range(10)]
    return ev.evaluation_counts(truth, spark.createDataFrame(preds, PREDS), "base", 0.6)


def test_choice_of_the_fallback(spark):
    registry = spark.createDataFrame(
        [("base", True, True, 0), ("late", False, True, 3), ("early", False, True, 1), ("paid", False, False, 2)], REGISTRY
    )
    counts = ranked(spark, {"base": 9, "late": 7, "early": 7, "paid": 10})
    best = ev.best_local(counts, registry, "base").collect()
    assert [(r.model, r.accuracy, r.net_gain) for r in best] == [("early", 0.7, -2)]
    table = {r.model: (r.place, r.net_gain, r.is_chosen) for r in ev.ranking(counts, registry, "base").collect()}
    assert table == {"paid": (1, 1, False), "base": (2, 0, False), "early": (3, -2, True), "late": (3, -2, False)}
    nothing = ranked(spark, {"base": 5, "late": 0, "early": 0})
    assert ev.best_local(nothing, registry, "base").count() == 0
    assert not any(r.is_chosen for r in ev.ranking(nothing, registry, "base").collect())


def test_availability(spark, data):
    registry = spark.createDataFrame([("m1", False, True, 0), ("never", False, True, 1)], REGISTRY)
    got = {r.model: (r.is_available, r.n_predictions) for r in ev.availability(registry, data[3]).collect()}
    assert got == {"m1": (True, 300), "never": (False, 0)}


def test_sweep_by_hand(spark, data):
    truth, preds, t, p = data
    known = {i: (y, c) for i, y, c in truth}
    base = {i: q for m, i, q in preds if m == "base"}
    rows = ev.threshold_sweep(t, p.filter("model = 'base'"), 10).collect()
    assert [round(r.threshold, 6) for r in sorted(rows, key=lambda r: r.threshold)] == [i / 10 for i in range(11)]
    for r in rows:
        above = [i for i in base if known[i][1] >= r.threshold]
        below = [i for i in base if known[i][1] < r.threshold]
        assert r.n_above == len(above) and r.coverage == pytest.approx(len(above) / 300)
        for share, ids in ((r.accuracy_above, above), (r.accuracy_below, below)):
            assert share == (pytest.approx(sum(base[i] == known[i][0] for i in ids) / len(ids)) if ids else None)


def test_scores_on_a_threshold_and_out_of_range(spark):
    values = [i / 100 for i in range(101)] + [-1.0, 1.5, 0.29, 0.57, 0.58]
    truth = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)], TRUTH)
    preds = spark.createDataFrame([("base", i, "a") for i in range(len(values))], PREDS)
    for r in ev.threshold_sweep(truth, preds, 100).collect():
        assert r.n_above == sum(v >= r.threshold for v in values)


def test_routed_accuracy_limits(data):
    rows = ev.routed_accuracy(data[2], data[3], "base", 20).collect()
    for model in ("m1", "m2"):
        own = {round(r.threshold, 6): r.accuracy for r in rows if r.model == model}
        base, mine = pairs_of(data, "base"), pairs_of(data, model)
        assert own[0.0] == pytest.approx(sum(y == p for y, p in base) / 300)
        assert own[1.05] == pytest.approx(sum(y == p for y, p in mine) / 300)


def test_summary_profile_and_shares(spark, data):
    s = ev.summary(data[2], data[3].filter("model = 'base'"), 0.6).first()
    high = pairs_of(data, "base", lambda c: c >= 0.6)
    assert s.total_reports == 300 and s.high_confidence_count == len(high)
    assert s.high_confidence_accuracy == pytest.approx(sum(y == p for y, p in high) / len(high))
    shares = ev.confidence_shares(data[2], 0.6).first()
    assert shares.n_high == len(high) and math.isclose(shares.share_high + shares.share_low, 1)
    corpus = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a")], "group_id string, label string")
    assert tuple(ev.corpus_profile(corpus).first()) == (3, 2, 2, 2)
