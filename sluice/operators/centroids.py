"""Centroid classifier: one normalised mean TF-IDF vector per class."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.row_terms import label_sums, text_label_sums
from sluice.operators.vectors import ClassWeights, term_index, vectorizer
from sluice.operators.vocabulary import NUMBERED_TERMS, fit_vocabulary, report_terms, report_texts
from sluice.params import CascadeParams
from sluice.session import StageStore


@dataclass(frozen=True)
class CentroidModel:
    params: CascadeParams
    vocabulary: DataFrame  # term, tf, df, idf
    vectorizer: PipelineModel
    weights: ClassWeights

    @property
    def counter(self) -> CountVectorizerModel:
        """terms -> counts, the first step of the vectorizer."""
        return self.vectorizer.stages[0]

    @property
    def labels(self) -> tuple[str, ...]:
        return self.weights.labels

    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.weights.table.write.mode("overwrite").parquet(f"{path}/weights")
        self.vectorizer.write().overwrite().save(f"{path}/vectorizer")
        about = {
            "params": self.params.to_json(),
            "labels": list(self.labels),
            "n_terms": self.weights.n_terms,
        }
        spark.createDataFrame([(json.dumps(about),)], "about string").write.mode(
            "overwrite"
        ).text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CentroidModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        weights = ClassWeights(
            spark.read.parquet(f"{path}/weights"), tuple(about["labels"]), about["n_terms"]
        )
        return cls(
            CascadeParams.from_json(about["params"]),
            spark.read.parquet(f"{path}/vocabulary"),
            PipelineModel.load(f"{path}/vectorizer"),
            weights,
        )


def class_centroids(vectors: DataFrame, store: StageStore) -> DataFrame:
    """label, idx, n_rows, w from (label, tfidf): the unit mean vector of each
    class, without zeros. Entries and rows are summed by (label, idx) by runs of
    vectors, then on the map side, in one pass over the vectors, and spread over
    idx, so no reducer holds a class; the stored sums give the rest, one row a
    class. A class of empty vectors has one row with NULL idx."""
    return _centroids(label_sums(vectors), store)


def _centroids(parts: DataFrame, store: StageStore) -> DataFrame:
    """class_centroids() from partial sums: label, idx, s, n."""
    one_pass = parts.groupBy("label", "idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums = store.put("class_sums", one_pass)
    square = F.when(F.col("idx").isNotNull(), F.col("s") * F.col("s")).otherwise(0.0)
    about = sums.groupBy("label").agg(F.sum("n").alias("n_rows"), F.sqrt(F.sum(square)).alias("length"))
    entries = sums.filter(F.col("idx").isNotNull() & (F.col("s") != 0)).select("label", "idx", "s")
    full = entries.join(F.broadcast(about), "label").select(
        "label", "idx", "n_rows", (F.col("s") / F.col("length")).alias("w")
    )
    none = about.filter("length = 0").select(
        "label", F.lit(None).cast("int").alias("idx"), "n_rows", F.lit(None).cast("double").alias("w")
    )
    return full.unionByName(none)


def weight_table(centroids: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """idx, weights (label order): the centroids turned by 90 degrees."""
    own = F.map_from_entries(F.collect_list(F.struct("label", "w")))  # one entry per class
    found = centroids.filter(F.col("idx").isNotNull()).groupBy("idx").agg(own.alias("m"))
    names = F.array(*[F.lit(x) for x in labels])
    weights = F.transform(names, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
    return found.select("idx", weights.alias("weights"))


def centroid_rows(model: CentroidModel) -> DataFrame:
    """label, term, w without zeros: the centroids in long form."""
    names = F.array(*[F.lit(x) for x in model.labels])
    index = term_index(model.weights.table.sparkSession, model.vectorizer)
    return (
        model.weights.table.join(F.broadcast(index), "idx")
        .select("term", F.posexplode("weights").alias("c", "w"))
        .filter(F.col("w") != 0)
        .select(F.element_at(names, F.col("c") + 1).alias("label"), "term", "w")
    )


def _label_parts(train: DataFrame, fitted: PipelineModel, params: CascadeParams) -> DataFrame:
    """Sums of the vectors by label and idx, to be added up. The terms of a
    smaller vocabulary are counted, scaled and summed where the text is read."""
    counter, scale = fitted.stages[:2]
    terms = counter.vocabulary
    if len(terms) > NUMBERED_TERMS:
        vectors = fitted.transform(report_terms(train, params, "label"))
        return label_sums(vectors.select("label", "tfidf"))
    factors = scale.getScalingVec().toArray()
    return text_label_sums(report_texts(train, "label"), terms, factors, params.stop_words, params.ngram_max)


def fit_centroids(train: DataFrame, params: CascadeParams, store: StageStore) -> CentroidModel:
    """Fit on report_id, text, label. Two scans of the text: one counts terms,
    one averages vectors."""
    vocab = store.put("vocabulary", fit_vocabulary(report_texts(train), params, store))
    fitted = vectorizer(vocab, params)
    centroids = store.put("centroids", _centroids(_label_parts(train, fitted, params), store))
    names = centroids.select("label").distinct().orderBy("label").limit(params.max_labels + 1)
    labels = tuple(r.label for r in names.collect())
    if len(labels) > params.max_labels:
        raise ValueError(f"more than {params.max_labels} classes")
    idf = term_index(train.sparkSession, fitted).join(vocab.select("term", "idf"), "term")
    table = store.put(
        "weights", weight_table(centroids, labels).join(idf, "idx").select("idx", "idf", "weights")
    )
    n_terms = len(fitted.stages[0].vocabulary)
    return CentroidModel(params, vocab, fitted, ClassWeights(table, labels, n_terms))
