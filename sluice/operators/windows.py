"""Stage 2: windows of each report scored against its candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import add_terms, token_windows, window_count, word_tokens
from sluice.operators.candidates import label_array, pick, ranked_indices
from sluice.operators.centroids import CentroidModel
from sluice.operators.vectors import count_scores
from sluice.params import CascadeParams

WHOLE = -1  # chunk_index of the whole report among its windows


def report_windows(reports: DataFrame, params: CascadeParams, *keep: str) -> DataFrame:
    """report_id, further columns, chunk_index, tokens: overlapping windows of
    each report."""
    tokens = reports.select("report_id", *keep, word_tokens(F.col("text")).alias("tokens"))
    # There is always a window; the outer variant spares a size check that
    # would cut the text twice.
    windows = token_windows(
        F.col("tokens"), params.window_tokens, params.window_overlap, params.max_windows
    )
    return tokens.select("report_id", *keep, F.posexplode_outer(windows).alias("chunk_index", "tokens"))


def window_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def coverage(reports: DataFrame, params: CascadeParams, limit: int, cap: int) -> DataFrame:
    """One row: share of reports longer than `limit` tokens, share longer than
    `cap` windows reach, and how many tokens lie beyond."""
    reach = params.window_tokens + (cap - 1) * params.window_step
    n = F.size(word_tokens(F.col("text")))
    counted = reports.select(n.alias("n"))
    return counted.agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.avg((F.col("n") > limit).cast("int")).alias("share_over_limit"),
        F.avg((F.col("n") > reach).cast("int")).alias("share_over_cap"),
        F.sum(F.greatest(F.col("n") - reach, F.lit(0))).alias("tokens_over_cap"),
        F.sum(
            window_count(F.col("n"), params.window_tokens, params.window_overlap, params.max_windows)
        ).alias("n_windows"),
    )


def scoring_units(reports: DataFrame, params: CascadeParams) -> DataFrame:
    """report_id, chunk_index, terms: the whole report and each window of it."""
    tokens = reports.select("report_id", word_tokens(F.col("text")).alias("tokens"))
    windows = F.transform(
        token_windows(
            F.col("tokens"), params.window_tokens, params.window_overlap, params.max_windows
        ),
        lambda w, i: F.struct(i.alias("chunk_index"), w.alias("tokens")),
    )
    whole = F.array(F.struct(F.lit(WHOLE).alias("chunk_index"), F.col("tokens")))
    # Never empty; explode_outer keeps Spark from computing it twice to check.
    units = tokens.select("report_id", F.explode_outer(F.concat(whole, windows)).alias("u"))
    return add_terms(
        units.select("report_id", "u.chunk_index", "u.tokens"),
        "tokens",
        params.stop_words,
        params.ngram_max,
    )


def unit_scores(reports: DataFrame, model: CentroidModel) -> DataFrame:
    """report_id, chunk_index, scores. One scan of the text serves both
    stages; only one small row per window leaves the task that read it."""
    units = model.counter.transform(scoring_units(reports, model.params))
    return count_scores(units, model.weights, "report_id", "chunk_index")


def softmax(scores: Column, scale: float) -> Column:
    """Probabilities over one array of scores; the maximum is taken off first."""
    powers = F.transform(
        scores, lambda s: F.exp((s - F.array_max(scores)) * F.lit(float(scale)))
    )
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def window_evidence(
    scores: DataFrame, model: CentroidModel, candidates: DataFrame | None = None
) -> DataFrame:
    """report_id, chunk_index, candidates, probabilities, top_label, score.
    Candidates come from the whole-report row, or from a caller's own Stage 1
    as (report_id, candidates)."""
    params, labels = model.params, label_array(model.labels)
    windows = scores.filter(F.col("chunk_index") != WHOLE)
    if candidates is None:
        # A partition holds the windows of one report.
        by_report = Window.partitionBy("report_id").orderBy("chunk_index")
        whole = F.first("scores").over(by_report)
        placed = (
            scores.withColumn("at", ranked_indices(whole, params.top_k, params.tie_decimals))
            .filter(F.col("chunk_index") != WHOLE)
            .withColumn("candidates", pick(labels, F.col("at")))
        )
    else:
        at = F.transform("candidates", lambda c: F.array_position(labels, c).cast("int") - 1)
        placed = windows.join(candidates.select("report_id", "candidates"), "report_id")
        placed = placed.withColumn("at", at)
    # A candidate the model doesn't know scores 0.
    chosen = F.transform(pick(F.col("scores"), F.col("at")), lambda s: F.coalesce(s, F.lit(0.0)))
    scored = placed.withColumn("chosen", chosen).withColumn(
        "probabilities", softmax(F.col("chosen"), params.softmax_scale)
    )
    return best_candidate(scored, params.tie_decimals).select(
        "report_id", "chunk_index", "candidates", "probabilities", "top_label", "score"
    )


def best_candidate(df: DataFrame, decimals: int) -> DataFrame:
    """Adds top_label and score: the best of the candidates, the earlier
    candidate on a tie."""
    best = F.get(ranked_indices(F.col("probabilities"), 1, decimals), F.lit(0))
    return (
        df.withColumn("_best", best)
        .withColumn("top_label", F.get("candidates", F.col("_best")))
        .withColumn("score", F.get("probabilities", F.col("_best")))
        .drop("_best")
    )


def best_window(evidence: DataFrame, decimals: int) -> DataFrame:
    """report_id, candidates, hybrid_label, score: the most confident window
    decides, the earliest one on a tie."""
    order = F.struct(
        F.round("score", decimals).alias("rounded"),
        (-F.col("chunk_index")).alias("earlier"),
        F.col("top_label"),
        F.col("score"),
        F.col("candidates"),
    )
    best = evidence.groupBy("report_id").agg(F.max(order).alias("b"))
    return best.select(
        "report_id",
        "b.candidates",
        F.col("b.top_label").alias("hybrid_label"),
        F.col("b.score").alias("score"),
    )


def with_defaults(candidates: DataFrame, best: DataFrame) -> DataFrame:
    """Every report with candidates gets a decision: one without any scored
    window falls back to candidate 1 with score -1."""
    found = best.select("report_id", "hybrid_label", "score")
    return candidates.join(found, "report_id", "left").select(
        "report_id",
        "candidates",
        F.coalesce("hybrid_label", F.get("candidates", F.lit(0))).alias("hybrid_label"),
        F.coalesce("score", F.lit(-1.0)).alias("score"),
    )


#: Scores of a caller's own: (report_id, chunk_index, tokens, candidates) rows in,
#: (report_id, chunk_index, label, raw_score) rows out.
WindowScorer = Callable[[DataFrame], DataFrame]


def own_evidence(
    reports: DataFrame, candidates: DataFrame, scorer: WindowScorer, params: CascadeParams, scale: float = 1.0
) -> DataFrame:
    """Window evidence from a caller's scorer. A window row carries its words
    and its report's candidates, so it is scored in place: the text moves at
    most once, whole, for the join with the candidates, and is cut after. Reports whose windows the
    scorer leaves out have no evidence; with_defaults() decides them."""
    both = reports.select("report_id", "text").join(candidates.select("report_id", "candidates"), "report_id")
    windows = report_windows(both, params, "candidates")
    return evidence_from_rows(scorer(windows), candidates, scale, params.tie_decimals)


def window_candidates(windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """report_id, chunk_index, rank, label: what a caller's own window scorer
    has to score; each window meets only its own report's few candidates."""
    ranked = candidates.select("report_id", F.posexplode_outer("candidates").alias("rank", "label"))
    return windows.select("report_id", "chunk_index").join(ranked, "report_id").select(
        "report_id", "chunk_index", (F.col("rank") + 1).alias("rank"), "label"
    )


def evidence_from_rows(
    rows: DataFrame, candidates: DataFrame, scale: float, decimals: int
) -> DataFrame:
    """Window evidence from a caller's (report_id, chunk_index, label,
    raw_score) rows; a missing candidate scores 0. Per window there are at
    most top_k rows."""
    packed = F.map_from_entries(F.collect_list(F.struct("label", "raw_score")))
    found = rows.groupBy("report_id", "chunk_index").agg(packed.alias("m"))
    joined = found.join(candidates.select("report_id", "candidates"), "report_id")
    chosen = F.transform("candidates", lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0)))
    scored = joined.withColumn("chosen", chosen).withColumn(
        "probabilities", softmax(F.col("chosen"), scale)
    )
    return best_candidate(scored, decimals).select(
        "report_id", "chunk_index", "candidates", "probabilities", "top_label", "score"
    )


def explain(reports: DataFrame, evidence: DataFrame, params: CascadeParams) -> DataFrame:
    """report_id, chunk_evidence: all windows of the given reports with text,
    label and score, in window order. The evidence of a report is gathered
    into one short row and joined to the report, whose windows are cut inside
    its row after that: the text moves once, whole, and no window on its own.
    Pass only the reports asked about."""
    facts = evidence.groupBy("report_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "top_label", "score"))).alias("facts")
    )
    both = reports.select("report_id", "text").join(facts, "report_id")
    tokens = both.select("report_id", "facts", word_tokens(F.col("text")).alias("tokens"))
    windows = token_windows(F.col("tokens"), params.window_tokens, params.window_overlap, params.max_windows)
    # A row of its own for the array: it is cut once, not once for each fact.
    cut = tokens.select("report_id", "facts", F.explode_outer(F.array(windows)).alias("windows"))
    told = F.transform(
        "facts",
        lambda f: F.struct(
            f["chunk_index"].alias("chunk_index"),
            window_text(F.get("windows", f["chunk_index"])).alias("chunk_text"),
            f["top_label"].alias("top_label"),
            f["score"].alias("score"),
        ),
    )
    return cut.select("report_id", told.alias("chunk_evidence"))
