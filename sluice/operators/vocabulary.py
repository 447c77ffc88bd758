"""Term statistics, vocabulary and inverse document frequency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import add_terms, word_tokens
from sluice.operators.row_terms import known_counts, ngram_cells, partial_ngrams, partial_statistics
from sluice.params import CascadeParams
from sluice.session import StageStore


def report_tokens(df: DataFrame, *keep: str) -> DataFrame:
    """Report id, further columns, and the array of word tokens."""
    return df.select("report_id", *keep, word_tokens(F.col("text")).alias("tokens"))


def report_texts(df: DataFrame, *keep: str) -> DataFrame:
    """Report id, further columns, and the lower-case text, whose words are
    found where they are counted (row_terms.coded_words())."""
    return df.select("report_id", *keep, F.lower("text").alias("lowered"))


def report_terms(df: DataFrame, params: CascadeParams, *keep: str) -> DataFrame:
    """Report id, further columns, and the array of vectorizer terms."""
    return add_terms(report_tokens(df, *keep), "tokens", params.stop_words, params.ngram_max)


def term_occurrences(documents: DataFrame) -> DataFrame:
    """term, is_new: a row for each occurrence. Each term array is sorted and
    laid beside itself, shifted by one, so a term that differs from the one
    before it (is_new) stands for the document."""
    ordered = documents.select(F.sort_array("terms").alias("term"))
    size = F.greatest(F.size("term") - 1, F.lit(0))
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice("term", F.lit(1), size))
    # explode_outer: for explode, Spark would first filter on the array's size
    # and compute the whole array once more for it.
    pairs = ordered.select("term", shifted.alias("before")).select(
        F.explode_outer(F.arrays_zip("term", "before")).alias("x")
    )
    met = pairs.select("x.term", "x.before").filter(F.col("term").isNotNull())
    return met.select("term", (~F.col("term").eqNullSafe(F.col("before"))).alias("is_new"))


def counted_terms(occurrences: DataFrame) -> DataFrame:
    """term, tf, df: one grouping by term with map-side sums."""
    counts = [F.count(F.lit(1)).alias("tf"), F.count_if("is_new").alias("df")]
    return occurrences.groupBy("term").agg(*counts)


def term_statistics(documents: DataFrame) -> DataFrame:
    """term, tf (occurrences), df (documents). Runs of documents are counted
    as they are read; their short rows are added up by term."""
    return _added(partial_statistics(documents))


def token_statistics(documents: DataFrame, params: CascadeParams) -> DataFrame:
    """The same from documents' tokens or texts, whose terms never become rows of
    text of their own."""
    return _added(partial_ngrams(documents, params.stop_words, params.ngram_max))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(
    stats: DataFrame, n_documents: int, max_features: int | None, min_df: int
) -> DataFrame:
    """The max_features most frequent terms with df >= min_df, ties in term
    order: term, tf, df, idf. A histogram over size classes of tf (at most 16
    per power of two) first finds the class the last kept term lies in, so
    only a little more than max_features terms are ever sorted."""
    frequent = stats.filter(F.col("df") >= min_df)
    idf = inverse_document_frequency(n_documents, F.col("df")).alias("idf")
    if max_features is None:
        return frequent.select("term", "tf", "df", idf)
    size_class = F.floor(F.log2(F.col("tf").cast("double")) * 16).cast("int")
    classed = frequent.withColumn("size_class", size_class)
    downwards = Window.orderBy(F.desc("size_class")).rowsBetween(Window.unboundedPreceding, 0)
    histogram = classed.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"))
    lowest = (
        histogram.withColumn("upto", F.sum("n").over(downwards))
        .filter(F.col("upto") - F.col("n") < max_features)
        .agg(F.coalesce(F.min("size_class"), F.lit(0)))
        .scalar()
    )
    return (
        classed.filter(F.col("size_class") >= lowest)
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
        .select("term", "tf", "df", idf)
    )


def inverse_document_frequency(n_documents: int, df: Column) -> Column:
    """Smoothed: as if one more document held every term."""
    return F.log(F.lit(n_documents + 1.0) / (df.cast("double") + 1.0)) + 1.0


def fit_vocabulary(documents: DataFrame, params: CascadeParams, store: StageStore) -> DataFrame:
    """Vocabulary of the given (training) documents, which bring their terms
    or, cheaper, their texts (report_texts()) or tokens. The term counts of the
    corpus are kept as a stage table, without the many terms that too few
    documents hold; both passes over them are cheap."""
    if "terms" in documents.columns:
        counted = term_statistics(documents)
        stats = store.put("term_statistics", counted.filter(F.col("df") >= params.min_df))
    else:
        stats = frequent_statistics(documents, params, store)
    return vocabulary(stats, documents.count(), params.max_features, params.min_df)


def frequent_statistics(documents: DataFrame, params: CascadeParams, store: StageStore) -> DataFrame:
    """Exact term, tf, df of all terms the vocabulary can hold; most others never
    leave the task that reads them. A first pass adds up the n-grams' occurrences
    in cells. A second counts n-grams whose cell reaches a bound: cells never count
    too little, so all that occur so often are met. If these are not max_features
    with enough documents, the bound was guessed too high and is lowered; at
    min_df it bars nothing that a vocabulary holds."""
    cells = ngram_cells(documents, params.stop_words, params.ngram_max)
    bound = _guessed_bound(cells, params.max_features, params.min_df)
    while True:
        parts = partial_ngrams(documents, params.stop_words, params.ngram_max, cells >= bound)
        stats = store.put("term_statistics", _added(parts).filter(F.col("df") >= params.min_df))
        if bound <= params.min_df or stats.filter(F.col("tf") >= bound).count() >= params.max_features:
            return stats
        bound = max(params.min_df, bound // 4)


def _guessed_bound(cells: np.ndarray, max_features: int | None, min_df: int) -> int:
    """Half of what the max_features-th largest cell holds more than the median one."""
    if max_features is None or max_features > len(cells):
        return min_df
    last = np.partition(cells, len(cells) - max_features)[len(cells) - max_features]
    return max(min_df, int(last - np.median(cells)) // 2)


# Vocabularies of up to so many terms are broadcast, some 100 bytes a term.
BROADCAST_TERMS = 1_000_000
# Up to so many are numbered by the driver and looked up inside the rows.
NUMBERED_TERMS = 200_000


def match_vocabulary(documents: DataFrame, vocab: DataFrame, n_terms: int | None = None) -> DataFrame:
    """Document terms that are in the vocabulary with their in-document
    counts: report_id, term, tf, idf. The join comes first: it drops the
    out-of-vocabulary terms before anything is shuffled. n_terms: how many
    terms the vocabulary has at most; few enough are broadcast, so that a
    frequent term is nobody's shuffle key. Else Spark decides by size.

    Terms of a smaller vocabulary are numbered and counted inside the document's
    row, so that what moves, by report id, is a row of numbers for each document
    (the counts of rows that share an id are added up)."""
    if n_terms is not None and n_terms <= NUMBERED_TERMS:
        rows = [r for r in vocab.select("term", "idf").collect() if r.term is not None]
        terms = [r.term for r in rows]
        if len(set(terms)) == len(terms):
            return _numbered_match(documents, terms, [r.idf for r in rows])
    exploded = documents.select("report_id", F.explode_outer("terms").alias("term"))
    side = vocab.select("term", "idf")
    if n_terms is not None and n_terms <= BROADCAST_TERMS:
        side = F.broadcast(side)
    known = exploded.join(side, "term")
    return known.groupBy("report_id", "term", "idf").agg(F.count(F.lit(1)).alias("tf"))


def _numbered_match(documents: DataFrame, terms: list[str], idf: list[float]) -> DataFrame:
    numbered = pd.DataFrame({"idx": range(len(terms)), "term": terms, "idf": idf})
    index = documents.sparkSession.createDataFrame(numbered, "idx int, term string, idf double")
    moved = known_counts(documents, terms).repartition("report_id")
    pairs = moved.select("report_id", F.inline_outer(F.arrays_zip("idx", "x")))
    counts = pairs.filter(F.col("idx").isNotNull()).groupBy("report_id", "idx").agg(F.sum("x").alias("tf"))
    return counts.join(F.broadcast(index), "idx").select("report_id", "term", "idf", "tf")
