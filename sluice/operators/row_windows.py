"""All windows of a report scored inside its row, by prefix sums.

The class products idf * weight of a report's term occurrences are summed up
along its tokens once; what a window holds is the difference of two of these
sums, so overlapping windows share the work. A bigram counts for a window if both
its tokens lie inside. A window's length (its unit vector's denominator) comes
from one sort of its (window, term) pairs.

A row goes in with its text and comes out with its scores: no window is a row of
its own before it is short, and nothing is shuffled. The model's terms and
weights are sent to the tasks once, if they stay under MODEL_BYTES; a larger
model scores by windows.unit_scores(). Rows are judged one by one, so report ids
should be unique (plans.cascade.classify() sees to it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.candidates import label_array, pick, ranked_indices
from sluice.operators.centroids import CentroidModel
from sluice.operators.row_terms import coded_words, known_terms, lookup, one_by_one, pair_counts, runs, word_characters
from sluice.operators.windows import best_candidate, softmax

MODEL_BYTES = 256 << 20
TERM_BYTES = 32  # of a term, on average
TOKENS_AT_ONCE = 200_000
NUMBERS_AT_ONCE = 4_000_000


def fits(model: CentroidModel) -> bool:
    """Whether the model is small enough to be sent to every task."""
    return model.weights.n_terms * (8 * len(model.labels) + TERM_BYTES) <= MODEL_BYTES


def _model_arrays(model: CentroidModel) -> tuple[tuple, np.ndarray, np.ndarray]:
    """lookup() of the terms in index order, idf * weights, squared idf. A term
    without class weights counts for nothing. Tasks get it ready made: there are
    many, and some have few rows."""
    terms = model.counter.vocabulary
    products = np.zeros((len(terms), len(model.labels)))
    square = np.zeros(len(terms))
    for r in model.weights.table.select("idx", "idf", "weights").collect():
        products[r.idx] = np.array(r.weights) * r.idf
        square[r.idx] = r.idf * r.idf
    return lookup(terms), products, square


def _units(sizes: np.ndarray, window: int, step: int, cap: int | None) -> tuple[np.ndarray, ...]:
    """(report, start, stop) of each report as a whole and of its windows, in
    token positions over all reports; the whole comes first."""
    counts = np.ceil(np.maximum(sizes - window, 0) / step).astype(np.int64) + 1
    if cap is not None:
        counts = np.minimum(counts, cap)
    report = np.repeat(np.arange(len(sizes)), counts + 1)
    place = np.arange(len(report)) - np.repeat(np.cumsum(counts + 1) - counts - 1, counts + 1) - 1
    whole = place < 0
    begin = np.where(whole, 0, place * step)
    end = np.where(whole, sizes[report], np.minimum(begin + window, sizes[report]))
    base = (np.cumsum(sizes) - sizes)[report]
    return counts, report, base + begin, base + end


def _sums(terms: np.ndarray, products: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Class sums and squared lengths of the occurrences low to high of each unit."""
    high = np.maximum(high, low)
    sums = np.empty((len(low), products.shape[1]))
    columns = max(1, NUMBERS_AT_ONCE // max(1, len(terms)))
    for c in range(0, products.shape[1], columns):
        along = np.zeros((len(terms) + 1, min(columns, products.shape[1] - c)))
        np.cumsum(products[terms, c : c + columns], axis=0, out=along[1:])
        sums[:, c : c + columns] = along[high] - along[low]
    many = high - low
    unit = np.repeat(np.arange(len(low)), many)
    inside = np.arange(len(unit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    pair, n = np.unique(unit * len(square) + terms[inside], return_counts=True)
    lengths = np.bincount(
        pair // max(1, len(square)), weights=n * n * square[pair % max(1, len(square))], minlength=len(low)
    )
    return sums, lengths


def score_rows(
    coded: tuple, model: tuple, stop_words: pa.Array, ngram_max: int, window: int, step: int, cap: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """(windows of each report, scores of each unit) from reports' coded_words()."""
    terms, products, square = model
    counts, _, start, stop = _units(coded[0], window, step, cap)
    sums, lengths = np.zeros((len(start), products.shape[1])), np.zeros(len(start))
    for ids, first, last in known_terms(coded, terms, stop_words, ngram_max):
        more, longer = _sums(ids, products, square, np.searchsorted(first, start), np.searchsorted(last, stop))
        sums, lengths = sums + more, lengths + longer
    length = np.sqrt(lengths)[:, None]
    return counts, np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)


def row_scores(reports: DataFrame, model: CentroidModel) -> DataFrame:
    """report_id, whole (scores of the whole report), windows (scores of each)."""
    params = model.params
    kind = reports.schema["report_id"].dataType.simpleString()
    sent = reports.sparkSession.sparkContext.broadcast(_model_arrays(model))
    window, step, cap = params.window_tokens, params.window_step, params.max_windows
    ngram_max, stop_words, bits = params.ngram_max, list(params.stop_words), word_characters()

    def scored(batches) -> Iterator[pa.RecordBatch]:
        held = sent.value
        stops, characters = pa.array(stop_words, pa.string()), np.unpackbits(bits).view(bool)
        for batch in one_by_one(batches):
            texts = batch.column("lowered")
            for a, n in runs(texts, TOKENS_AT_ONCE):
                coded = coded_words(texts.slice(a, n), characters)
                counts, scores = score_rows(coded, held, stops, ngram_max, window, step, cap)
                yield _row_batch(batch.column("report_id").slice(a, n), counts, scores)
            del batch, texts

    rows = reports.select("report_id", F.lower("text").alias("lowered"))
    return rows.mapInArrow(scored, f"report_id {kind}, whole array<double>, windows array<array<double>>")


def whole_sums(reports: DataFrame, model: CentroidModel) -> DataFrame:
    """report_id, sums, square: of each report as a whole, the class products
    of its term occurrences added up, and its squared length."""
    kind = reports.schema["report_id"].dataType.simpleString()
    sent = reports.sparkSession.sparkContext.broadcast(_model_arrays(model))
    ngram_max, stop_words, bits = model.params.ngram_max, list(model.params.stop_words), word_characters()

    def summed(batches) -> Iterator[pa.RecordBatch]:
        terms, products, square = sent.value
        stops = pa.array(stop_words, pa.string())
        characters = np.unpackbits(bits).view(bool)
        k = products.shape[1]
        for batch in one_by_one(batches):
            texts = batch.column("lowered")
            for a, n in runs(texts, TOKENS_AT_ONCE):
                part = coded_words(texts.slice(a, n), characters)
                ends = np.cumsum(part[0])
                sums, squares = np.zeros((n, k)), np.zeros(n)
                for ids, first, _ in known_terms(part, terms, stops, ngram_max):
                    owner, idx, times = pair_counts(np.searchsorted(ends, first, side="right"), ids, len(square))
                    for c in range(k):
                        sums[:, c] += np.bincount(owner, weights=times * products[idx, c], minlength=n)
                    squares += np.bincount(owner, weights=times * times * square[idx], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("report_id").slice(a, n), _arrays(sums), pa.array(squares)],
                    names=["report_id", "sums", "square"],
                )
            del batch, texts

    rows = reports.select("report_id", F.lower("text").alias("lowered"))
    return rows.mapInArrow(summed, f"report_id {kind}, sums array<double>, square double")


def _arrays(m: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.float64())
    )


def _row_batch(ids: pa.Array, counts: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    whole = np.cumsum(counts + 1) - counts - 1
    others = np.delete(scores, whole, axis=0)
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [ids, _arrays(scores[whole]), pa.ListArray.from_arrays(offsets, _arrays(others))],
        names=["report_id", "whole", "windows"],
    )


def row_evidence(reports: DataFrame, model: CentroidModel, candidates: DataFrame | None = None) -> DataFrame:
    """What windows.window_evidence() gives: report_id, chunk_index, candidates,
    probabilities, top_label, score. Without candidates of the caller's own there
    is no exchange at all; with them, score rows meet them by report id."""
    params, labels = model.params, label_array(model.labels)
    rows = row_scores(reports, model)
    if candidates is None:
        at = ranked_indices(F.col("whole"), params.top_k, params.tie_decimals)
        placed = rows.select("report_id", "windows", at.alias("at"))
        placed = placed.withColumn("candidates", pick(labels, F.col("at")))
    else:
        at = F.transform("candidates", lambda c: F.array_position(labels, c).cast("int") - 1)
        placed = rows.join(candidates.select("report_id", "candidates"), "report_id")
        placed = placed.select("report_id", "windows", at.alias("at"), "candidates")
    # Never empty: a text without tokens has one window.
    units = placed.select("report_id", "candidates", "at", F.posexplode_outer("windows").alias("chunk_index", "s"))
    # A candidate the model doesn't know scores 0.
    chosen = F.transform(pick(F.col("s"), F.col("at")), lambda s: F.coalesce(s, F.lit(0.0)))
    scored = units.withColumn("chosen", chosen).withColumn(
        "probabilities", softmax(F.col("chosen"), params.softmax_scale)
    )
    return best_candidate(scored, params.tie_decimals).select(
        "report_id", "chunk_index", "candidates", "probabilities", "top_label", "score"
    )
