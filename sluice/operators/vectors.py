"""TF-IDF vectors and their products with class weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.dual_ascent import Rows, margins
from sluice.operators.row_terms import known_counts, list_sizes
from sluice.params import CascadeParams


def vectorizer(vocab: DataFrame, params: CascadeParams) -> PipelineModel:
    """terms -> tfidf (sparse, L2-normalised). Only the vocabulary reaches the
    driver: at most max_features terms, numbered in term order."""
    rows = sorted((r.term, r.idf) for r in vocab.select("term", "idf").collect())
    # A vocabulary without terms still makes vectors, all of them empty.
    terms = [t for t, _ in rows] or [""]
    counter = _counter(terms)
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([idf for _, idf in rows] or [0.0]),
        inputCol="counts",
        outputCol="scaled",
    )
    unit = Normalizer(p=2.0, inputCol="scaled", outputCol="tfidf")
    return PipelineModel([counter, scale, unit])


def _counter(terms: list[str]) -> CountVectorizerModel:
    """CountVectorizerModel.from_vocabulary() for many terms: that sends them to
    the JVM one call each (6 s for 50,000), this in one. Terms hold no line
    break; should one do, the slow way is taken."""
    if any("\n" in t for t in terms) or "" in terms:
        return CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="counts")
    jvm = SparkSession.active().sparkContext._jvm
    words = jvm.java.util.regex.Pattern.compile("\n").split("\n".join(terms))
    own = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", words)
    own.setInputCol("terms").setOutputCol("counts")._set(vocabSize=len(terms))
    return own


def term_index(spark: SparkSession, fitted: PipelineModel) -> DataFrame:
    """idx, term of a fitted vectorizer."""
    numbered = list(enumerate(fitted.stages[0].vocabulary))
    return spark.createDataFrame(pd.DataFrame(numbered, columns=["idx", "term"]), "idx int, term string")


def vector_entries(df: DataFrame, *keys: str, vector: str = "tfidf") -> DataFrame:
    """Vectors as rows: keys, idx, w. A vector without entries yields one row
    with NULL idx, so no document gets lost. A dense vector has no indices:
    there the place is the index."""
    raw = df.select(*keys, F.unwrap_udt(vector).alias("v"))
    pairs = F.transform(
        "v.values",
        lambda w, i: F.struct(F.coalesce(F.get("v.indices", i), i).alias("idx"), w.alias("w")),
    )
    rows = raw.select(*keys, F.posexplode_outer(pairs).alias("pos", "e"))
    # begins: the entry that stands for the vector, so that vectors can be counted.
    begins = (F.coalesce("pos", F.lit(0)) == 0).alias("begins")
    return rows.select(*keys, "e.idx", "e.w", begins)


def tfidf_rows(documents: DataFrame, fitted: PipelineModel) -> DataFrame:
    """report_id, term, w: the vector of each report in long form, computed
    by runs of reports (what fitted.transform() gives row by row)."""
    counter, scale = fitted.stages[:2]
    vectors = known_counts(documents, counter.vocabulary, scale.getScalingVec().toArray())
    entries = vectors.select("report_id", F.inline_outer(F.arrays_zip("idx", F.col("x").alias("w"))))
    index = term_index(documents.sparkSession, fitted)
    return entries.filter(F.col("idx").isNotNull()).join(F.broadcast(index), "idx").select("report_id", "term", "w")


# Columns of class weights summed side by side: more would leave whole-stage
# code generation (spark.sql.codegen.maxFields) and broadcast more at once.
BLOCK_LABELS = 64
# Bytes of class weights broadcast at once; the rest follows in further blocks.
BLOCK_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class ClassWeights:
    """idx, weights array (one entry per label, in label order), and for
    scoring straight from term counts also idf."""

    table: DataFrame
    labels: tuple[str, ...]
    n_terms: int

    def blocks(self) -> list[range]:
        """Label positions, in blocks small enough to broadcast. There are no
        more blocks than labels: one label's weights are one number a term."""
        fitting = max(1, BLOCK_BYTES // (8 * max(1, self.n_terms)) - 4)
        size = min(BLOCK_LABELS, fitting)
        n = len(self.labels)
        return [range(i, min(i + size, n)) for i in range(0, n, size)] or [range(0)]

    def side(self, block: range) -> DataFrame:
        rest = [c for c in self.table.columns if c not in ("idx", "weights")]
        part = F.slice("weights", block.start + 1, max(1, len(block))).alias("weights")
        return F.broadcast(self.table.select("idx", *rest, part))


def _summed(
    entries: DataFrame, weights: ClassWeights, keys: tuple[str, ...], value: Column, whole: list[Column]
) -> DataFrame:
    """keys, the sums named in `whole`, scores: per key the sum of value times
    class weight for every label. Each block of labels is one broadcast join
    and one grouping with map-side sums (all entries of a vector come from one
    row); the short score rows of the blocks are joined by key."""
    done = None
    for block in weights.blocks():
        joined = entries.join(weights.side(block), "idx", "left").withColumn("_x", value)
        sums = [F.sum(F.col("_x") * F.get("weights", F.lit(k))).alias(f"s{k}") for k in range(len(block))]
        grouped = joined.groupBy(*keys).agg(*(whole if done is None else []), *sums)
        array = F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(len(block))])
        own = [c for c in grouped.columns if c not in {f"s{k}" for k in range(len(block))}]
        part = grouped.select(*own, array.cast("array<double>").alias("scores"))
        if done is None:
            done = part
        else:
            more = part.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("scores").alias("_more"))
            same = [done[k].eqNullSafe(more[f"_{k}"]) for k in keys]
            done = done.join(more, same).select(
                *[c for c in done.columns if c != "scores"], F.concat("scores", "_more").alias("scores")
            )
    return done


def shared(scores: Column, by: Column) -> Column:
    return F.transform(scores, lambda s: F.coalesce(F.try_divide(s, by), F.lit(0.0)))


def score_arrays(entries: DataFrame, weights: ClassWeights, *keys: str) -> DataFrame:
    """keys, scores: all class scores of a vector in one array, label order.
    Rows that repeat a key with the same vector are one vector."""
    rows = F.count_if("begins").alias("rows")
    done = _summed(entries, weights, keys, F.col("w"), [rows])
    return done.select(*keys, shared(F.col("scores"), F.col("rows")).alias("scores"))


def row_scores(vectors: DataFrame, weights: np.ndarray, *keys: str) -> DataFrame:
    """The same from vectors, by weights that are sent to the tasks (terms and an
    intercept x classes): a vector is scored in its row, and only scores move."""
    # By rows: taking some of them would else copy the whole.
    sent = vectors.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights))
    v = F.unwrap_udt("tfidf")
    rows = vectors.select(
        *keys,
        F.coalesce(v["indices"], F.transform(v["values"], lambda _, i: i)).alias("idx"),
        v["values"].alias("val"),
    )

    def scored(batches):
        for batch in batches:
            lists = batch.column("idx")
            met = Rows(np.array(lists.flatten()), np.array(batch.column("val").flatten()), list_sizes(lists))
            found = margins(met, sent.value)
            ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            scores = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], scores], names=[*keys, "scores"])

    kinds = "".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}, " for k in keys)
    each = rows.mapInArrow(scored, f"{kinds}scores array<double>")
    sums = [F.avg(F.col("scores")[i]) for i in range(weights.shape[1])]
    return each.groupBy(*keys).agg(F.array(*sums).alias("scores"))


def class_scores(entries: DataFrame, weights: ClassWeights, *keys: str) -> DataFrame:
    """keys, label, score: the dot product of each vector with each class,
    one row per class. The products are summed as arrays first."""
    names = F.array(*[F.lit(x) for x in weights.labels])
    rows = score_arrays(entries, weights, *keys)
    return rows.select(*keys, F.posexplode("scores").alias("c", "score")).select(
        *keys, F.element_at(names, F.col("c") + 1).alias("label"), "score"
    )


def count_scores(df: DataFrame, weights: ClassWeights, *keys: str) -> DataFrame:
    """keys, scores from rows with a `counts` vector. The vector's length is
    one more sum in the same grouping, so counts are scored without building
    the TF-IDF vectors first. Rows that repeat a key with the same vector are
    one vector: n of them make the sums n times and the length sqrt(n) times
    as large."""
    entries = vector_entries(df, *keys, vector="counts")
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")) * F.count_if("begins")).alias("length")
    done = _summed(entries, weights, keys, F.col("w") * F.col("idf"), [length])
    return done.select(*keys, shared(F.col("scores"), F.col("length")).alias("scores"))
