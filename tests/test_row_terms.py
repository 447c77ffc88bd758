"""Terms counted by runs of rows: the numbers of a plain computation, and what moves."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sluice.functions.text import word_tokens
from sluice.operators import centroids as cen
from sluice.operators import row_terms
from sluice.operators import vocabulary as voc
from sluice.operators import windows as win
from sluice.operators.candidates import report_scores
from sluice.operators.vectors import vectorizer
from sluice.params import CascadeParams
from sluice.plans import training
from sluice.session import StageStore

P = CascadeParams(min_df=2, stop_words=("the", "of"), window_tokens=6, window_overlap=2)


def texts():
    rng = random.Random(7)
    words = ["renal", "cortex", "the", "of", "lung", "Überall", "a1", "lobe"]
    rows = [(i % 40, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    return [*rows, (100, None), (None, "lung lobe lung lobe"), (None, None), (101, "the of the")]


def terms_of(text):
    words = [w for w in (text or "").lower().split() if w not in P.stop_words]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("row_terms") / "reports")
    spark.createDataFrame(texts(), "report_id int, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("at_once", [row_terms.TERMS_AT_ONCE, 7])
def test_statistics_of_terms_and_of_tokens(reports, monkeypatch, at_once):
    monkeypatch.setattr(row_terms, "TERMS_AT_ONCE", at_once)
    tf, df = Counter(), Counter()
    for _, text in texts():
        tf.update(terms_of(text))
        df.update(set(terms_of(text)))
    want = {t: (tf[t], df[t]) for t in tf}
    for made in (voc.term_statistics(voc.report_terms(reports, P)), voc.token_statistics(voc.report_tokens(reports), P)):
        assert {r.term: (r.tf, r.df) for r in made.collect()} == want


def test_rare_terms_are_not_stored(spark, reports, tmp_path):
    store = StageStore(spark, str(tmp_path))
    voc.fit_vocabulary(voc.report_tokens(reports), P, store)
    assert spark.read.parquet(store.path("term_statistics")).filter("df < 2").count() == 0


@pytest.mark.parametrize("most, guess", [(3, None), (5, None), (1_000, None), (None, None), (3, 10_000), (1_000, 10_000)])
def test_barred_ngrams_leave_the_vocabulary_as_it_is(spark, reports, tmp_path, monkeypatch, most, guess):
    """Rare n-grams are dropped before they are counted; a bound guessed too high is lowered."""
    if guess:
        monkeypatch.setattr(voc, "_guessed_bound", lambda cells, max_features, min_df: guess)
    params = CascadeParams(min_df=2, max_features=most, stop_words=P.stop_words)
    store = StageStore(spark, str(tmp_path))
    everything = voc.fit_vocabulary(voc.report_terms(reports, params), params, store)
    want = {tuple(r) for r in everything.collect()}
    for documents in (voc.report_texts(reports), voc.report_tokens(reports)):
        assert {tuple(r) for r in voc.fit_vocabulary(documents, params, store).collect()} == want


def test_cells_never_count_too_little_and_bar_rare_ngrams(reports):
    tf = Counter(t for _, text in texts() for t in terms_of(text))
    cells = row_terms.ngram_cells(voc.report_texts(reports), P.stop_words, 2)
    assert cells.sum() == sum(tf.values())
    kept = row_terms.partial_ngrams(voc.report_texts(reports), P.stop_words, 2, cells >= 20)
    got = {r.term: r.tf for r in kept.groupBy("term").agg(F.sum("tf").alias("tf")).collect()}
    assert got == {t: n for t, n in tf.items() if n >= 20} and len(got) < len(tf)


def test_match_adds_up_repeated_ids_and_moves_rows_of_numbers(spark, reports, tmp_path):
    vocab = voc.fit_vocabulary(voc.report_tokens(reports), P, StageStore(spark, str(tmp_path)))
    known = {r.term: r.idf for r in vocab.collect()}
    want = Counter()
    for i, text in texts():
        want.update((i, t) for t in terms_of(text) if t in known)
    match = voc.match_vocabulary(voc.report_terms(reports, P), vocab, 50_000)
    assert {(r.report_id, r.term): r.tf for r in match.collect()} == want
    assert all(r.idf == pytest.approx(known[r.term]) for r in match.collect())
    exchanged = [x.split("\n")[0] for x in plan_of(match).split(") Exchange\n")[1:] if x.startswith("Input")]
    assert exchanged and all("idx" in x and "term" not in x for x in exchanged)


def test_sums_of_sparse_dense_and_empty_vectors(spark, store):
    rows = [("a", Vectors.sparse(4, {0: 1.0, 2: 2.0})), ("a", Vectors.dense([1.0, 0.0, 0.0, 5.0])),
            ("b", Vectors.sparse(4, {})), (None, Vectors.sparse(4, {1: 3.0})), ("a", None)]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("label", T.StringType()), T.StructField("tfidf", VectorUDT())])
    got, n = defaultdict(dict), Counter()
    for r in row_terms.label_sums(spark.createDataFrame(rows, shape)).groupBy("label", "idx").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")
    ).collect():
        n[r.label] += r.n
        if r.idx is not None:
            got[r.label][r.idx] = r.s
    assert n == {"a": 3, "b": 1, None: 1}
    assert {k: {i: s for i, s in v.items() if s} for k, v in got.items()} == {"a": {0: 2.0, 2: 2.0, 3: 5.0}, None: {1: 3.0}}


def test_scores_and_windows_leave_no_term_rows(spark, reports, tmp_path):
    labelled = reports.filter("text IS NOT NULL AND report_id IS NOT NULL").withColumn("label", F.expr("if(report_id % 2 = 0, 'a', 'b')"))
    model = cen.fit_centroids(labelled, P, StageStore(spark, str(tmp_path)))
    plan = plan_of(report_scores(reports, model))
    assert "Generate" not in plan and "Join" not in plan and "MapInArrow" in plan
    # Windows are cut after the text has moved.
    evidence = spark.createDataFrame([(1, 0, "a", 0.5)], "report_id int, chunk_index int, top_label string, score double")
    logical = win.explain(reports, evidence, P)._jdf.queryExecution().optimizedPlan().toString()
    assert logical.index("Generate") < logical.index("Join") and logical.index("regexp_extract_all") < logical.index("Join")


def test_texts_are_cut_into_the_words_spark_finds(spark):
    """Every character, letters newer than the JVM's Unicode among them, between
    two letters, before one, and alone."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}z {chr(c)} " for c in codes[i : i + 5000]) for i in range(0, len(codes), 5000)]
    plain = ["ab", "cd", "e", "f gh", ""]
    rows = spark.createDataFrame([(t,) for t in [*plain, *texts, None, "", " x ", "İI ΑΣ É_9\n٣٤"]], "text string")
    got = rows.select(word_tokens(F.col("text")).alias("tokens"), F.lower("text").alias("lowered")).toArrow()
    lowered, tokens = (got.column(c).combine_chunks() for c in ("lowered", "tokens"))
    characters = np.unpackbits(row_terms.word_characters()).view(bool)
    for a, n in [(0, len(lowered)), (0, 5), (1, 2), (len(lowered) - 4, 2), (len(lowered) - 2, 2), (2, 0)]:
        sizes, numbers, words = row_terms.coded_words(lowered.slice(a, n), characters)
        assert sizes.tolist() == row_terms.list_sizes(tokens.slice(a, n)).tolist()
        assert words.take(pa.array(numbers)).to_pylist() == tokens.slice(a, n).flatten().to_pylist()


@pytest.mark.parametrize("at_once", [row_terms.TERMS_AT_ONCE, 7])
@pytest.mark.parametrize("held", [row_terms.SUMS_AT_ONCE, 1])
def test_label_sums_of_texts_are_those_of_their_vectors(spark, tmp_path, monkeypatch, at_once, held):
    monkeypatch.setattr(row_terms, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(row_terms, "SUMS_AT_ONCE", held)
    texts = ["Red red apple, green apple", "green leaf x", None, "", "red apple red apple", "of the", "green leaf red"]
    rows = [(i, t, [None, "a", "b"][i % 3]) for i, t in enumerate(texts * 3)]
    reports = spark.createDataFrame(rows, "report_id int, text string, label string").repartition(2)
    fitted = vectorizer(voc.fit_vocabulary(voc.report_texts(reports), P, StageStore(spark, str(tmp_path))), P)

    def summed(parts):
        found = parts.groupBy("label", "idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        return {(r.label, r.idx): (r.s and round(r.s, 12), r.n) for r in found}

    vectors = fitted.transform(voc.report_terms(reports, P, "label"))
    made = row_terms.text_label_sums(
        voc.report_texts(reports, "label"), fitted.stages[0].vocabulary, fitted.stages[1].getScalingVec().toArray(),
        P.stop_words, P.ngram_max,
    )
    assert "MapInArrow" in plan_of(made) and summed(made) == summed(row_terms.label_sums(vectors.select("label", "tfidf")))


def test_a_model_is_fitted_without_finding_words_in_the_plan(spark, store, monkeypatch):
    """Texts go to Python whole, for statistics as for sums; and how far the
    corpus is dealt out is asked of its files, not of the join, which would run."""
    plans = []
    put, spread = StageStore.put, training.spread_small
    monkeypatch.setattr(StageStore, "put", lambda self, name, df, *a: plans.append(plan_of(df)) or put(self, name, df, *a))
    monkeypatch.setattr(training, "spread_small", lambda df: plans.append(plan_of(df)) or spread(df))
    rows = [(i, f"g{i}", "red apple leaf") for i in range(40)]
    reports = spark.createDataFrame(rows, "report_id int, group_id string, text string")
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "report_id int, label string")
    run = training.train(reports, labels, P, store, "report_id")
    assert run.model.labels == ("a", "b") and run.corpus.count() == 40
    assert not any("regexp_extract_all" in p for p in plans)
    asked = [p for p in plans if "Join" not in p and "Scan parquet" in p and "group_id" in p]
    assert asked and sum("Join" in p and "text" in p for p in plans) == 1
