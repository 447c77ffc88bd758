"""Vocabulary, vectors and centroids against a plain Python computation."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.operators import candidates as cand
from sluice.operators import centroids as cen
from sluice.operators import vectors as vec
from sluice.operators import vocabulary as voc
from sluice.params import CascadeParams
from sluice.session import StageStore

TEXTS = [
    (1, "renal cell tumor renal tumor", "A"),
    (2, "lung tumor no nodule", "B"),
    (3, "renal clear cell cell", "A"),
    (4, "lung nodule lung", "B"),
    (5, "", "B"),
    (6, "the of", "A"),
]
PARAMS = CascadeParams(max_features=9, min_df=2, stop_words=("of", "the"), ngram_max=2)


def python_terms(text):
    words = [w for w in text.split() if w not in ("of", "the")]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def python_model():
    docs = {i: Counter(python_terms(t)) for i, t, _ in TEXTS}
    tf, df = Counter(), Counter()
    for counts in docs.values():
        tf.update(counts)
        df.update(counts.keys())
    kept = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:9]
    idf = {t: math.log((len(docs) + 1) / (df[t] + 1)) + 1 for t in kept}
    vectors = {}
    for i, counts in docs.items():
        raw = {t: c * idf[t] for t, c in counts.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        vectors[i] = {t: x / norm for t, x in raw.items()}
    sums, sizes = defaultdict(Counter), Counter()
    for i, _, label in TEXTS:
        sizes[label] += 1
        for t, x in vectors[i].items():
            sums[label][t] += x
    centroids = {}
    for label, s in sums.items():
        mean = {t: x / sizes[label] for t, x in s.items()}
        norm = math.sqrt(sum(x * x for x in mean.values()))
        centroids[label] = {t: x / norm for t, x in mean.items()}
    return tf, df, idf, vectors, centroids


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TEXTS, "report_id long, text string, label string")


@pytest.fixture(scope="module")
def model(spark, train, tmp_path_factory):
    return cen.fit_centroids(train, PARAMS, StageStore(spark, str(tmp_path_factory.mktemp("fit"))))


def test_vocabulary(model):
    tf, df, idf, _, _ = python_model()
    got = {r.term: (r.tf, r.df, r.idf) for r in model.vocabulary.collect()}
    assert got == {t: (tf[t], df[t], pytest.approx(idf[t])) for t in idf}


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 100])
def test_vocabulary_cap_breaks_ties_by_term(spark, cap):
    stats = spark.createDataFrame(
        [("b", 5, 2), ("a", 5, 2), ("c", 5, 2), ("d", 1000, 3), ("e", 2, 2), ("f", 900, 1)], "term string, tf long, df long"
    )
    got = [r.term for r in voc.vocabulary(stats, 10, cap, 2).orderBy(F.desc("tf"), "term").collect()]
    assert got == ["d", "a", "b", "c", "e"][:cap]


def test_vectors(spark, train, model):
    _, _, _, vectors, _ = python_model()
    documents = voc.report_terms(train, PARAMS)
    got = defaultdict(dict)
    for r in vec.tfidf_rows(documents, model.vectorizer).collect():
        got[r.report_id][r.term] = r.w
    assert got == {i: pytest.approx(v) for i, v in vectors.items() if v}


def test_centroids(model):
    got = defaultdict(dict)
    for r in cen.centroid_rows(model).collect():
        got[r.label][r.term] = r.w
    assert got == {k: pytest.approx(v) for k, v in python_model()[4].items()}
    assert model.labels == ("A", "B")


def expected_scores():
    _, _, _, vectors, centroids = python_model()
    return {
        i: [sum(x * centroids[c].get(t, 0) for t, x in v.items()) for c in ("A", "B")]
        for i, v in vectors.items()
    }


@pytest.mark.parametrize("wide", [64, 1])
def test_scores_by_blocks_of_labels(monkeypatch, train, model, wide):
    """One block or one for each class: same numbers."""
    monkeypatch.setattr(vec, "BLOCK_LABELS", wide)
    want = {i: pytest.approx(s) for i, s in expected_scores().items()}
    got = {r.report_id: list(r.scores) for r in cand.report_scores(train, model).collect()}
    assert got == want
    vectors = model.vectorizer.transform(voc.report_terms(train, PARAMS))
    entries = vec.vector_entries(vectors, "report_id")
    again = vec.score_arrays(entries, model.weights, "report_id")
    assert {r.report_id: list(r.scores) for r in again.collect()} == want
    rows = vec.class_scores(entries, model.weights, "report_id").collect()
    assert {(r.report_id, r.label): pytest.approx(r.score) for r in rows} == {
        (i, c): s for i, both in expected_scores().items() for c, s in zip(("A", "B"), both)
    }


def test_repeated_rows_score_like_one(train, model):
    want = {i: pytest.approx(s) for i, s in expected_scores().items()}
    twice = train.unionAll(train)
    assert {r.report_id: list(r.scores) for r in cand.report_scores(twice, model).collect()} == want


def test_dense_vectors_have_scores(spark, train, model):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = model.vectorizer.transform(voc.report_terms(train, PARAMS))
    dense = vectors.select("report_id", array_to_vector(vector_to_array("tfidf")).alias("tfidf"))
    got = vec.score_arrays(vec.vector_entries(dense, "report_id"), model.weights, "report_id")
    want = {i: pytest.approx(s) for i, s in expected_scores().items()}
    assert {r.report_id: list(r.scores) for r in got.collect()} == want


def test_candidates_break_ties_by_label(spark):
    scores = spark.createDataFrame([(1, [0.5, 0.7, 0.5, 0.7000000001]), (2, [0.0, 0.0, 0.0, 0.0])], "report_id long, scores array<double>")
    labels = ["a", "b", "c", "d"]
    got = {r.report_id: r.candidates for r in cand.top_candidates(scores, labels, 3, 6).collect()}
    assert got == {1: ["b", "d", "a"], 2: ["a", "b", "c"]}
    wide = {r.report_id: r.candidates for r in cand.top_candidates(scores, labels, 9, 6).collect()}
    assert wide[1] == ["b", "d", "a", "c"]
    rows = scores.select("report_id", F.posexplode("scores").alias("i", "score")).select(
        "report_id", F.element_at(F.array(*map(F.lit, labels)), F.col("i") + 1).alias("label"), "score"
    )
    long = cand.top_candidates_long(rows, 3, 6).orderBy("report_id", "rank").collect()
    assert [r.label for r in long if r.report_id == 1] == ["b", "d", "a"]


def test_candidate_recall(spark):
    found = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["c", "b"])], "report_id long, candidates array<string>")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "report_id long, y_true string")
    got = {r.k: r.recall for r in cand.candidate_recall(found, truth, 2).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: pytest.approx(2 / 3)}


def test_model_survives_saving(spark, train, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = cen.CentroidModel.load(spark, str(tmp_path / "m"))
    before = cand.report_scores(train, model)
    after = cand.report_scores(train, again)
    assert again.params == PARAMS and again.labels == model.labels
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0


def test_too_many_classes(spark, train, store):
    with pytest.raises(ValueError):
        cen.fit_centroids(train, CascadeParams(max_labels=1, max_features=9), store)
