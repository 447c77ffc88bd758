"""Training: labelled corpus, split, model."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.centroids import CentroidModel, fit_centroids
from sluice.operators.joins import labelled_corpus
from sluice.operators.linear_models import (
    CalibratedSvm,
    Logistic,
    fit_calibrated,
    fit_logistic,
    holdout_scores,
)
from sluice.operators.splits import group_split, leaked_groups, stratified_folds
from sluice.operators.vectors import vectorizer
from sluice.operators.vocabulary import fit_vocabulary, report_terms, report_texts
from sluice.params import CascadeParams
from sluice.session import StageStore
from sluice.sources.reports import spread_small


@dataclass(frozen=True)
class Training:
    corpus: DataFrame  # report_id, group_id, text, label, split
    model: CentroidModel
    store: StageStore

    def part(self, split: str) -> DataFrame:
        return self.corpus.filter(F.col("split") == split)


def split_corpus(
    reports: DataFrame,
    labels: DataFrame,
    params: CascadeParams,
    store: StageStore,
    key: str = "group_id",
    validation_share: float = 0.0,
) -> DataFrame:
    """The labelled corpus, joined and written once, with its split; where the
    sides end follows from the stored groups, which are short rows. One that fills
    few files is small: it is dealt out and written again. That is seen from the
    files, as the join would have to run to tell."""
    joined = store.put("corpus", labelled_corpus(reports, labels, key))
    dealt = spread_small(joined)
    corpus = joined if dealt is joined else store.put("dealt_corpus", dealt)
    groups = store.put("groups", corpus.select("group_id").distinct())
    return group_split(corpus, "group_id", params.test_share, params.seed, validation_share, groups).select(
        "report_id", "group_id", "text", "label", "split"
    )


def train(
    reports: DataFrame,
    labels: DataFrame,
    params: CascadeParams,
    store: StageStore,
    key: str = "group_id",
    validation_share: float = 0.0,
) -> Training:
    """Join, split, check for leakage, fit on the training side."""
    corpus = split_corpus(reports, labels, params, store, key, validation_share)
    if leaked_groups(corpus).first().leaked_groups:
        raise ValueError("a group is on more than one side of the split")
    training = corpus.filter(F.col("split") == "train")
    return Training(corpus, fit_centroids(training, params, store), store)


@dataclass(frozen=True)
class Classifiers:
    """The two fitted models, and how they do on the held-out side."""

    vectorizer: PipelineModel
    logistic: Logistic
    svm: CalibratedSvm
    vectors: DataFrame  # report_id, label, split, tfidf
    counts: DataFrame  # model, y_true, pred, n on the test side

    def part(self, split: str) -> DataFrame:
        return self.vectors.filter(F.col("split") == split)

    def save(self, path: str) -> None:
        self.vectorizer.write().overwrite().save(f"{path}/vectorizer")
        self.logistic.save(f"{path}/logistic")
        self.svm.save(f"{path}/svm")


def load_classifiers(spark: SparkSession, path: str) -> tuple[PipelineModel, Logistic, CalibratedSvm]:
    return (
        PipelineModel.load(f"{path}/vectorizer"),
        Logistic.load(spark, f"{path}/logistic"),
        CalibratedSvm.load(spark, f"{path}/svm"),
    )


def split_vectors(corpus: DataFrame, params: CascadeParams, store: StageStore) -> tuple[DataFrame, PipelineModel]:
    """report_id, label, split, tfidf of a split corpus, written once, by the
    vocabulary of its training side."""
    documents = report_terms(corpus, params, "label", "split")
    training = report_texts(corpus.filter(F.col("split") == "train"))
    vocab = store.put("fit_vocabulary", fit_vocabulary(training, params, store))
    fitted = vectorizer(vocab, params)
    vectors = fitted.transform(documents).select("report_id", "label", "split", "tfidf")
    return store.put("vectors", vectors), fitted


def train_classifiers(
    corpus: DataFrame, params: CascadeParams, store: StageStore, folds: int = 5, with_full: bool = False
) -> Classifiers:
    """Fit logistic regression and the calibrated SVM on the training side of
    a split corpus and count their predictions on the test side, from which
    operators.evaluation gives accuracy, macro and weighted F1."""
    vectors, fitted = split_vectors(corpus, params, store)
    training, test = (vectors.filter(F.col("split") == s) for s in ("train", "test"))
    folded = store.put("folds", stratified_folds(training, folds, seed=params.seed))
    # The iterations of either are small jobs; they share the cluster.
    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(fit_logistic, training, StageStore(corpus.sparkSession))
        svm = fit_calibrated(folded, store, folds, with_full=with_full)
        logistic = other.result()
    truth = test.select("report_id", "label")
    counts = holdout_scores(logistic.transform(test), truth, "logistic").unionByName(
        holdout_scores(svm.transform(test), truth, "calibrated_svm")
    )
    return Classifiers(fitted, logistic, svm, vectors, store.put("counts", counts))
