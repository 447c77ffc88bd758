"""The Count-Min filter changes what is shuffled, never the vocabulary."""

import random
from dataclasses import replace

import pytest

from sluice.operators import frequent_terms as ft
from sluice.operators import vocabulary as voc
from sluice.params import CascadeParams

P = CascadeParams(min_df=2, max_features=40)


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    rows = [(i, [f"t{int(rng.paretovariate(0.5)) % 4000}" for _ in range(60)]) for i in range(120)]
    rows += [(500, None), (501, []), (502, ["only"] * 90), (503, ["t1", "t1"])]
    return spark.createDataFrame(rows, "report_id int, terms array<string>").repartition(3).cache()


@pytest.mark.parametrize(
    "changes,width,depth,naming",
    [
        ({}, 1 << 14, 2, 2_000),
        ({}, 64, 1, 2_000),  # a crowded table bars little
        ({}, 1 << 14, 3, 1),  # one report names candidates
        ({"max_features": 100_000}, 1 << 14, 2, 2_000),
        ({"max_features": None}, 1 << 14, 2, 2_000),
        ({"min_df": 1, "max_features": 7}, 1 << 10, 2, 50),
    ],
)
def test_vocabulary_is_unchanged(documents, store, changes, width, depth, naming):
    params = replace(P, **changes)
    got = ft.frequent_vocabulary(documents, params, store, width, depth, naming)
    want = voc.fit_vocabulary(documents, params, store)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_terms_are_shuffled(documents):
    candidates = ft.candidate_terms(documents, P.max_features)
    sketch = ft.term_sketch(documents, candidates, 1 << 14).cache()
    bound = ft.lower_bound(sketch, P.max_features, P.min_df)
    every = voc.term_occurrences(documents)
    left = ft.surviving(every, ft.bitmaps(sketch, bound, P.min_df, 1 << 14), 1 << 14)
    whole = voc.counted_terms(every)
    assert bound == sorted((r.tf for r in whole.collect() if r.df >= 2), reverse=True)[39]
    n, m = left.select("term").distinct().count(), whole.count()
    assert 40 <= n <= 60 and m > 500


def test_no_documents(spark, store):
    empty = spark.createDataFrame([], "report_id int, terms array<string>")
    assert ft.frequent_vocabulary(empty, P, store).count() == 0
