"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the cores. Every query runs whole, into a sink that discards the
rows; the faster of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from sluice.catalog import fixtures as fx
from sluice.catalog.queries import QUERIES
from sluice.plans import cascade
from sluice.session import StageStore, local_session

HEADLINE = (
    "group_split",
    "stratified_folds",
    "group_label_join",
    "word_tokens",
    "report_ngrams",
    "token_windows",
    "term_statistics",
    "tfidf_vectors",
    "log_metrics",
    "log_metrics_by",
    "model_comparison",
    "recovery",
    "threshold_sweep",
    "routed_accuracy",
    "explanations",
    "own_window_scorer",
    "subset_comparison",
    "stream_daily_metrics",
)
RUNS = 2


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best_of(run) -> float:
    times = []
    for _ in range(RUNS):
        started = time.perf_counter()
        run()
        times.append(time.perf_counter() - started)
    return round(min(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "sluice-bench")
    spark.sparkContext.setLogLevel("ERROR")
    model = fx.training(spark, sf_dir).model
    reports = fx.reports(spark, sf_dir)
    seconds = {
        "train": best_of(lambda: fx.training(spark, sf_dir)),
        "classify": best_of(
            lambda: discard(cascade.classify(reports, model, StageStore(spark)).results)
        ),
    }
    for name in HEADLINE:
        seconds[name] = best_of(lambda: discard(QUERIES[name](spark, sf_dir)))
    n = reports.count()
    print(
        json.dumps({
            "metric": "total seconds of the headline queries",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": sf_dir.rsplit("sf", 1)[-1],
            "reports": n,
            "classify_seconds_per_report": round(seconds["classify"] / n, 6),
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
