"""Stage 1: the top-k classes of each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.centroids import CentroidModel
from sluice.operators.vectors import BLOCK_LABELS, count_scores, shared
from sluice.operators.vocabulary import report_terms


def ranked_indices(scores: Column, k: int, decimals: int) -> Column:
    """Positions of the k best scores, best first. Equal scores (to
    `decimals` places) go to the lower position, i.e. label order."""
    keyed = F.transform(
        scores, lambda s, i: F.struct((-F.round(s, decimals)).alias("s"), i.alias("i"))
    )
    return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda x: x["i"])


def label_array(labels) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def pick(values: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(values, i))


def report_scores(reports: DataFrame, model: CentroidModel) -> DataFrame:
    """report_id, scores over all classes. A model small enough to be sent to
    the tasks sums up the class products inside the row; one short row for each
    report is all that moves. Rows that repeat an id count as in count_scores()."""
    from sluice.operators import row_windows  # it ranks by the functions above

    if row_windows.fits(model) and len(model.labels) <= BLOCK_LABELS:
        rows = row_windows.whole_sums(reports, model)
        sums = [F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(len(model.labels))]
        length = F.sqrt(F.sum("square") * F.count(F.lit(1))).alias("length")
        array = F.array(*[F.col(f"s{c}") for c in range(len(model.labels))]).cast("array<double>")
        return rows.groupBy("report_id").agg(length, *sums).select(
            "report_id", shared(array, F.col("length")).alias("scores")
        )
    documents = report_terms(reports, model.params)
    return count_scores(model.counter.transform(documents), model.weights, "report_id")


def top_candidates(scores: DataFrame, labels, k: int, decimals: int) -> DataFrame:
    """report_id, candidates (codes, best first), candidate_scores. Works
    inside the row: no window, no shuffle."""
    ranked = scores.withColumn("at", ranked_indices(F.col("scores"), k, decimals))
    return ranked.select(
        "report_id",
        pick(label_array(labels), F.col("at")).alias("candidates"),
        pick(F.col("scores"), F.col("at")).alias("candidate_scores"),
    )


def top_candidates_long(scores: DataFrame, k: int, decimals: int) -> DataFrame:
    """The same from (report_id, label, score) rows, as (report_id, rank,
    label, score); a window holds at most one row per class."""
    order = Window.partitionBy("report_id").orderBy(F.desc(F.round("score", decimals)), "label")
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("report_id", "rank", "label", "score")
    )


def hard_prediction(scores: DataFrame, labels, decimals: int) -> DataFrame:
    """report_id, prediction: candidate 1."""
    return top_candidates(scores, labels, 1, decimals).select(
        "report_id", F.col("candidates")[0].alias("prediction")
    )


def candidate_recall(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """k, share of reports whose true label is among the first k, for every
    k up to the given one: the ceiling of all later stages."""
    place = F.array_position("candidates", F.col("y_true"))
    both = candidates.join(truth.select("report_id", "y_true"), "report_id")
    found = both.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    # `found` has at most k + 1 rows.
    total = F.sum("n").alias("total")
    hits = [
        F.sum(F.when((F.col("place") > 0) & (F.col("place") <= i), F.col("n")).otherwise(0)).alias(f"h{i}")
        for i in range(1, k + 1)
    ]
    row = found.agg(total, *hits)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"h{i}").alias("h")) for i in range(1, k + 1)])
    )
    return row.select("total", pairs.alias("p")).select(
        "p.k", (F.col("p.h") / F.col("total")).alias("recall")
    )
