"""The cascade over a table: candidates, windows, routing, response."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.answers import reject_reason
from sluice.operators import row_windows
from sluice.operators.candidates import report_scores, top_candidates
from sluice.operators.centroids import CentroidModel
from sluice.operators.routing import (
    fallback_answers,
    response_rows,
    routed_rows,
    split_by_threshold,
)
from sluice.operators.scorers import Context, get_backend
from sluice.operators.windows import (
    WindowScorer,
    best_window,
    own_evidence,
    unit_scores,
    window_evidence,
    with_defaults,
)
from sluice.session import StageStore


@dataclass
class Stages:
    """Stored outputs of Stages 1 and 2, the seconds each took and its rows."""

    evidence: DataFrame
    decisions: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


#: Ranks classes: (report_id, text) rows in, (report_id, candidates) rows out.
Stage1 = Callable[[DataFrame], DataFrame]


def run_stages(
    reports: DataFrame,
    model: CentroidModel,
    store: StageStore,
    candidates: DataFrame | None = None,
    window_scorer: WindowScorer | None = None,
    scale: float = 1.0,
) -> Stages:
    """Score all reports and decide. Both tables are stored: routing reads
    the decisions twice, explanations and re-routing come later. A caller may
    bring its own candidates and its own scorer of windows (scale: of the
    softmax over its raw scores). Report ids are unique."""
    started = time.perf_counter()
    if window_scorer is not None:
        if candidates is None:
            scores = report_scores(reports, model)
            p = model.params
            candidates = store.put("candidates", top_candidates(scores, model.labels, p.top_k, p.tie_decimals))
        found = own_evidence(reports, candidates, window_scorer, model.params, scale)
    elif row_windows.fits(model):
        found = row_windows.row_evidence(reports, model, candidates)
    else:
        found = window_evidence(unit_scores(reports, model), model, candidates)
    evidence = store.put("evidence", found, watch=True)
    scored = time.perf_counter()
    best = best_window(evidence, model.params.tie_decimals)
    # Reports with candidates, but without a scored window, are decided too.
    decided = best if candidates is None else with_defaults(candidates, best)
    decisions = store.put("decisions", decided, watch=True)
    return Stages(
        evidence,
        decisions,
        {"evidence": scored - started, "decisions": time.perf_counter() - scored},
        {name: store.rows[name] for name in ("evidence", "decisions")},
    )


def route(
    stages: Stages,
    model: CentroidModel,
    store: StageStore,
    backend: str = "window_mean",
    threshold: float | None = None,
    reports: DataFrame | None = None,
) -> DataFrame:
    """Routed rows from stored stages; calling it again with another threshold
    scores no window again."""
    limit = model.params.threshold if threshold is None else threshold
    kept, low = split_by_threshold(stages.decisions, limit)
    chosen = get_backend(backend)
    if chosen.needs_text:
        if reports is None:
            raise ValueError(f"backend {backend} needs the reports' text")
        low = low.join(reports.select("report_id", "text"), "report_id")
    scorer = chosen.make(Context(model, stages.evidence))
    answers = fallback_answers(low, scorer, model.params.retries, store)
    return routed_rows(kept, low, answers, backend)


@dataclass
class Classified:
    results: DataFrame
    rejects: DataFrame
    stages: Stages
    repeated: bool = False  # some ids occur more than once in the input


#: Repeated ids up to so many are broadcast, so that no other report moves.
BROADCAST_IDS = 1_000_000


def repeated_ids(checked: DataFrame) -> DataFrame:
    """report_id, copies, same_text of ids that occur more than once among the
    good rows of (report_id, reason, digest)."""
    seen = checked.filter(F.col("reason").isNull()).groupBy("report_id").agg(
        F.count(F.lit(1)).alias("copies"), (F.min("digest") == F.max("digest")).alias("same_text")
    )
    return seen.filter(F.col("copies") > 1)


def one_each(good: DataFrame, repeated: DataFrame, n_repeated: int) -> DataFrame:
    """report_id, text: one row of each id, none of ids that stand for different
    texts. Only reports that share their id with others are shuffled and sorted, unless
    the repeated ids are too many to be broadcast. Rows without id count as one."""
    if n_repeated > BROADCAST_IDS:
        mixed = repeated.filter(~F.col("same_text")).select("report_id")
        return good.join(mixed, "report_id", "left_anti").dropDuplicates(["report_id"])
    marks = F.broadcast(repeated.select(F.col("report_id").alias("_id"), "same_text"))
    marked = good.join(marks, F.col("report_id").eqNullSafe(F.col("_id")), "left")
    once = marked.filter(F.col("same_text").isNull()).select("report_id", "text")
    shared = marked.filter(F.col("same_text") | F.col("same_text").isNotNull() & F.col("report_id").isNull())
    return once.unionByName(shared.select("report_id", "text").dropDuplicates(["report_id"]))


def classify(
    reports: DataFrame,
    model: CentroidModel,
    store: StageStore,
    backend: str = "window_mean",
    run_id: str = "run",
    names: Column | None = None,
    validate: bool = True,
    stage1: Stage1 | None = None,
    window_scorer: WindowScorer | None = None,
    scale: float = 1.0,
    on_error: str = "reject",
) -> Classified:
    """Classify report_id, text. With validate, texts that are missing, too
    short or blank go to `rejects` with a reason and the rest goes on; without
    it (as in batch requests) only missing texts are rejected.

    Every input row is in results or rejects. Rows that repeat id and text get
    equal results, one each, with prediction ids of their own; rows whose id
    stands for different texts are rejected (ambiguous_id). Rows a fallback
    fails on are rejected with its error, or take candidate 1 with
    on_error="first_candidate". stage1 ranks the candidates instead of the
    model, window_scorer scores the windows instead of it."""
    if on_error not in ("reject", "first_candidate"):
        raise ValueError("on_error is reject or first_candidate")
    reason = reject_reason(F.col("text"))
    if not validate:
        reason = F.when(F.col("text").isNull(), "missing")
    good = reports.filter(reason.isNull()).select("report_id", "text")
    # A short row for each report tells which are refused and which are
    # repeated; the texts are read once for it and once to be scored.
    short = reports.select("report_id", reason.alias("reason"), F.xxhash64("text").alias("digest"))
    checked = store.put("checked", short)
    rejects = checked.filter(F.col("reason").isNotNull()).select("report_id", "reason")
    repeated = store.put("repeated_ids", repeated_ids(checked))
    n_repeated = repeated.count()
    copies, texts = None, good
    if n_repeated:
        copies = repeated.filter("same_text")
        mixed = repeated.filter(~F.col("same_text")).select("report_id")
        refused = checked.filter(F.col("reason").isNull()).join(mixed, "report_id", "left_semi")
        rejects = rejects.unionByName(refused.select("report_id", F.lit("ambiguous_id").alias("reason")))
        texts = one_each(good, repeated, n_repeated)
        if stage1 is not None:
            good = good.join(mixed, "report_id", "left_anti")
    candidates = None if stage1 is None else store.put("candidates", stage1(good).distinct())
    stages = run_stages(texts, model, store, candidates, window_scorer, scale)
    started = time.perf_counter()
    routed = store.put("routed", route(stages, model, store, backend, reports=texts), watch=True)
    stages.rows["routing"] = store.rows["routed"]
    stages.seconds["routing"] = time.perf_counter() - started
    if on_error == "reject":
        failed = routed.filter(F.col("error").isNotNull())
        failed = _each(failed.select("report_id", F.concat(F.lit("scorer: "), "error").alias("reason")), copies)
        rejects = rejects.unionByName(failed.drop("copy"))
        routed = routed.filter(F.col("error").isNull())
    results = response_rows(routed, run_id, names)
    if copies is not None:
        results = _each(results, copies)
        again = F.concat_ws("-", "prediction_id", F.nullif("copy", F.lit(0)).cast("string"))
        results = results.withColumn("prediction_id", again).drop("copy")
    return Classified(results, rejects, stages, copies is not None)


def _each(rows: DataFrame, copies: DataFrame | None) -> DataFrame:
    """One row for each copy of its report, numbered from 0."""
    if copies is None:
        return rows.withColumn("copy", F.lit(0))
    many = rows.join(copies.select("report_id", "copies"), "report_id", "left")
    last = F.coalesce("copies", F.lit(1)).cast("int") - 1
    return many.withColumn("copy", F.explode_outer(F.sequence(F.lit(0), last))).drop("copies")


def batch_totals(classified: Classified) -> DataFrame:
    """One row: total, succeeded, failed."""
    failed = classified.rejects.agg(F.count(F.lit(1))).scalar()
    done = classified.results.agg(F.count(F.lit(1)).alias("succeeded"))
    return done.select(
        (F.col("succeeded") + failed).alias("total"), "succeeded", failed.alias("failed")
    )


def stage_report(classified: Classified) -> list[dict[str, float | int | str]]:
    """Seconds, rows and rows per second of each stage. The rows were counted
    by the jobs that wrote the stages: nothing runs here."""
    stages = classified.stages
    return [
        {
            "stage": name,
            "seconds": seconds,
            "rows": stages.rows[name],
            "rows_per_second": stages.rows[name] / max(seconds, 1e-9),
        }
        for name, seconds in stages.seconds.items()
    ]


def throughput(classified: Classified) -> dict[str, float]:
    """Seconds of the run and distinct reports per second, from the stages'
    own counts; in a batch plan a single row has no latency of its own."""
    n = classified.stages.rows["routing"]
    total = sum(classified.stages.seconds.values())
    return {**classified.stages.seconds, "reports": n, "reports_per_second": n / max(total, 1e-9)}


def log_rows(classified: Classified, reports: DataFrame) -> DataFrame:
    """Results as prediction-log rows. latency_ms is the batch mean. The log
    keeps the text, so here it moves once; reports bucketed by report id
    (save_bucketed) stay in place."""
    speed = throughput(classified)
    latency = int(1000 / max(speed["reports_per_second"], 1e-9)) if speed["reports"] else 0
    texts = reports.select("report_id", F.col("text").alias("report_text"))
    if classified.repeated:
        texts = texts.dropDuplicates(["report_id"])
    return classified.results.join(texts, "report_id").select(
        F.col("prediction_id").alias("id"),
        "report_text",
        "prediction",
        "prediction_label",
        "routing_score",
        "routed_to",
        "reliability",
        "top_k_candidates",
        F.lit(latency).alias("latency_ms"),
    )
