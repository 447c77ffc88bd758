"""Folds that keep groups whole and labels even; percentiles from sketches."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.operators import latency_sketches as ls
from sluice.operators import splits


def grouped(n_small=300):
    rng = random.Random(1)
    rows = []
    for g in range(n_small):
        label = rng.choice("aaabbc")
        rows += [(f"s{g}", label if rng.random() < 0.8 else rng.choice("abc")) for _ in range(rng.randrange(1, 6))]
    for g in range(6):  # heavy groups, of one label each
        rows += [(f"h{g}", "abcabc"[g])] * (60 + 10 * g)
    rows += [(None, "a")] * 9
    return [(i, *r) for i, r in enumerate(rows)]


def test_folds(spark, store):
    rows = grouped()
    df = spark.createDataFrame(rows, "report_id int, group_id string, label string").repartition(4)
    done = splits.stratified_group_folds(df, store, 5)
    assert done.columns == ["report_id", "group_id", "label", "fold"]
    got = done.collect()
    assert sorted(r[:3] for r in got) == sorted(rows)
    folds, cells, sizes = defaultdict(set), Counter(), Counter()
    for r in got:
        folds[r.group_id].add(r.fold)
        cells[r.label, r.fold] += 1
        sizes[r.label] += 1
    assert all(len(f) == 1 for f in folds.values()) and {f for s in folds.values() for f in s} == set(range(5))
    heavy = Counter((r.group_id, r.label) for r in got)
    for label in "abc":
        most = max(n for (_, y), n in heavy.items() if y == label)
        assert all(abs(cells[label, f] - sizes[label] / 5) <= most for f in range(5)), cells


def test_folds_without_heavy_groups_are_even(spark, store):
    rows = [(i, f"g{i // 2}", "ab"[i // 2 % 2]) for i in range(4_000)]
    df = spark.createDataFrame(rows, "report_id int, group_id string, label string")
    done = splits.stratified_group_folds(df, store, 4).groupBy("label", "fold").count().collect()
    assert len(done) == 8 and all(abs(r["count"] - 500) <= 25 for r in done)
    assert splits.stratified_group_folds(df.limit(0), store, 4).count() == 0


def latencies():
    rng = random.Random(7)
    return [(i % 30, "abc"[i // 30 % 3], rng.lognormvariate(3, 1)) for i in range(30_000)]


@pytest.fixture(scope="module")
def log(spark):
    rows = [*latencies(), (1, "a", None), (2, "b", float("nan"))]
    return spark.createDataFrame(rows, "day int, routed_to string, ms double").repartition(6).cache()


def test_rolled_up_ranks_are_within_the_error(log):
    k = 400
    stored = ls.latency_sketches(log, ["day", "routed_to"], "ms", k).cache()
    assert stored.count() == 90 and stored.agg(F.max(F.octet_length("sketch"))).first()[0] < 12_000
    for keys in ([], ["routed_to"], ["day"]):
        for r in ls.rolled_up(stored, keys, k, (0.1, 0.5, 0.95)).collect():
            own = sorted(v for d, b, v in latencies() if ("day" not in keys or d == r.day) and ("routed_to" not in keys or b == r.routed_to))
            assert r.n == len(own)
            for p, value in ((0.1, r.p10), (0.5, r.p50), (0.95, r.p95)):
                assert abs(sum(v <= value for v in own) / len(own) - p) <= ls.rank_error(k) + 1 / len(own)


def test_a_day_written_again_counts_once(spark, log, tmp_path):
    made = ls.latency_sketches(log, ["day", "routed_to"], "ms")
    path = str(tmp_path / "sketches")
    for _ in range(2):
        ls.store_sketches(made, path)
    ls.store_sketches(made.filter("day < 3"), path)
    assert ls.rolled_up(ls.read_sketches(spark, path)).first().n == 30_000


def test_no_rows(log):
    none = ls.latency_sketches(log.limit(0), ["day"], "ms")
    assert tuple(ls.rolled_up(none).first()) == (0, None, None) and ls.rolled_up(none, ["day"]).count() == 0
