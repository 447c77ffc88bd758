"""Offline evaluation of stored predictions.

Everything starts from evaluation_counts(): one join by report id and one
grouping shrink truth and predictions to at most models x 2 x labels^2 x 2
rows; all tables below are computed from those counts.

Tables: truth = report_id, y_true, confidence; preds = model, report_id, pred;
registry = model, is_baseline, is_local, registry_order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.answers import confidence_band
from sluice.session import StageStore


def _hit() -> Column:
    return F.coalesce(F.col("y_true") == F.col("pred"), F.lit(False))


def evaluation_counts(
    truth: DataFrame, preds: DataFrame, baseline: str, threshold: float
) -> DataFrame:
    """model, band, y_true, pred, base_right, n."""
    base = preds.filter(F.col("model") == baseline).select(
        "report_id", F.col("pred").alias("base_pred")
    )
    known = truth.join(base, "report_id", "left").select(
        "report_id",
        "y_true",
        confidence_band(F.col("confidence"), threshold).alias("band"),
        F.coalesce(F.col("base_pred") == F.col("y_true"), F.lit(False)).alias("base_right"),
    )
    return (
        known.join(preds, "report_id")
        .groupBy("model", "band", "y_true", "pred", "base_right")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_all(counts: DataFrame) -> DataFrame:
    """Adds the band ALL by grouping sets."""
    sets = counts.groupingSets(
        [
            [F.col("model"), F.col("band"), F.col("y_true"), F.col("pred"), F.col("base_right")],
            [F.col("model"), F.col("y_true"), F.col("pred"), F.col("base_right")],
        ],
        F.col("model"), F.col("band"), F.col("y_true"), F.col("pred"), F.col("base_right"),
    ).agg(F.grouping("band").alias("_g"), F.sum("n").alias("n"))
    return sets.withColumn(
        "band", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("band"))
    ).drop("_g")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def accuracy(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, n, accuracy."""
    n = F.sum("n")
    right = F.sum(F.when(_hit(), F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg(n.alias("n"), (right / n).alias("accuracy"))


def class_scores_table(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, label, tp, fp, fn, support, precision, recall, f1 over the labels
    of truth and prediction; a division by zero counts as 0."""
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(_hit(), F.col("n")).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col("pred").alias("label"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("tp"),
        ),
    )
    sums = (
        counts.select(*keys, F.explode(sides).alias("s"))
        .select(*keys, "s.*")
        .filter(F.col("label").isNotNull())
        .groupBy(*keys, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        *keys,
        "label",
        "tp",
        (predicted - tp).alias("fp"),
        (support - tp).alias("fn"),
        "support",
        _rate(tp, predicted).alias("precision"),
        _rate(tp, support).alias("recall"),
        _rate(2 * tp, support + predicted).alias("f1"),
    )


def f1_scores(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, macro_f1, weighted_f1."""
    per_class = class_scores_table(counts, *keys)
    support = F.sum("support")
    return per_class.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / support).alias("weighted_f1"),
    )


def confusion(counts: DataFrame) -> DataFrame:
    """model, y_true, pred, n."""
    return counts.groupBy("model", "y_true", "pred").agg(F.sum("n").alias("n"))


def confusion_pivot(counts: DataFrame, labels: list[str]) -> DataFrame:
    """The confusion matrix with one column per predicted label."""
    wide = counts.groupBy("model", "y_true").pivot("pred", labels).agg(F.sum("n"))
    return wide.na.fill(0)


def comparison(counts: DataFrame, baseline: str) -> DataFrame:
    """model, band (ALL / HIGH / LOW), n, share, accuracy, macro_f1 and the
    change of accuracy against the baseline. Empty bands have no row."""
    leveled = with_all(counts)
    table = accuracy(leveled, "model", "band").join(
        f1_scores(leveled, "model", "band"), ["model", "band"]
    )
    by_band = Window.partitionBy("band")
    by_model = Window.partitionBy("model")
    whole = F.max(F.when(F.col("band") == "ALL", F.col("n"))).over(by_model)
    base = F.max(F.when(F.col("model") == baseline, F.col("accuracy"))).over(by_band)
    return table.select(
        "model",
        "band",
        "n",
        (F.col("n") / whole).alias("share"),
        "accuracy",
        "macro_f1",
        (F.col("accuracy") - base).alias("delta"),
    )


def recovery(counts: DataFrame, baseline: str, band: str = "LOW") -> DataFrame:
    """model, recoveries, regressions, both_wrong, net_gain on one band."""
    base = F.col("base_right")
    rows = counts.filter((F.col("band") == band) & (F.col("model") != baseline))

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    return rows.groupBy("model").agg(
        total(~base & _hit()).alias("recoveries"),
        total(base & ~_hit()).alias("regressions"),
        total(~base & ~_hit()).alias("both_wrong"),
        (total(~base & _hit()) - total(base & ~_hit())).alias("net_gain"),
    )


def subset_comparison(
    truth: DataFrame, preds: DataFrame, model: str, baseline: str, threshold: float, store: StageStore
) -> DataFrame:
    """A model evaluated on some reports only, against the baseline on the
    same reports: band, n, accuracies, change, recoveries, regressions. The
    counts, a few rows, are stored: the tables below read them several times."""
    ids = preds.filter(F.col("model") == model).select("report_id")
    same = truth.join(ids, "report_id", "left_semi")
    both = preds.filter(F.col("model").isin(model, baseline))
    counts = store.put("subset_counts", evaluation_counts(same, both, baseline, threshold))
    leveled = with_all(counts)
    table = comparison(counts, baseline).filter(
        (F.col("model") == model) & F.col("band").isin("ALL", "LOW")
    )
    mine = leveled.filter(F.col("model") == model)
    base = F.col("base_right")
    gains = mine.groupBy("band").agg(
        F.sum(F.when(~base & _hit(), F.col("n")).otherwise(0)).alias("recoveries"),
        F.sum(F.when(base & ~_hit(), F.col("n")).otherwise(0)).alias("regressions"),
        F.sum(F.when(~base & ~_hit(), F.col("n")).otherwise(0)).alias("both_wrong"),
    )
    return table.join(gains, "band").select(
        "band",
        "n",
        (F.col("accuracy") - F.col("delta")).alias("base_accuracy"),
        "accuracy",
        "macro_f1",
        "delta",
        "recoveries",
        "regressions",
        "both_wrong",
        (F.col("recoveries") - F.col("regressions")).alias("net_gain"),
    )


def availability(registry: DataFrame, preds: DataFrame) -> DataFrame:
    """model, is_available: registered models and whether they were run."""
    run = preds.groupBy("model").agg(F.count(F.lit(1)).alias("n_predictions"))
    return registry.join(run, "model", "left").select(
        "model",
        F.col("n_predictions").isNotNull().alias("is_available"),
        F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"),
    )


def _low_table(counts: DataFrame, registry: DataFrame, baseline: str) -> DataFrame:
    low = accuracy(counts.filter(F.col("band") == "LOW"), "model")
    gains = recovery(counts, baseline).select("model", "net_gain")
    return (
        registry.join(low, "model")
        .join(gains, "model", "left")
        .withColumn("net_gain", F.coalesce("net_gain", F.lit(0)))
    )


def _winner_order() -> list[Column]:
    return [F.desc("accuracy"), F.col("registry_order")]


def best_local(counts: DataFrame, registry: DataFrame, baseline: str) -> DataFrame:
    """model, accuracy, net_gain of the local model with the best accuracy on
    LOW rows. The baseline and paid models do not take part, the first one
    registered wins a tie, an accuracy of 0 does not win. One row per model,
    so the order needs no partition."""
    table = _low_table(counts, registry, baseline)
    fit = table.filter(F.col("is_local") & ~F.col("is_baseline") & (F.col("accuracy") > 0))
    return (
        fit.withColumn("place", F.row_number().over(Window.orderBy(*_winner_order())))
        .filter(F.col("place") == 1)
        .select("model", "accuracy", "net_gain")
    )


def ranking(counts: DataFrame, registry: DataFrame, baseline: str) -> DataFrame:
    """model, place, accuracy on LOW rows, net_gain, is_chosen."""
    table = _low_table(counts, registry, baseline)
    allowed = F.col("is_local") & ~F.col("is_baseline") & (F.col("accuracy") > 0)
    first = F.row_number().over(Window.partitionBy(allowed).orderBy(*_winner_order()))
    return table.select(
        "model",
        F.rank().over(Window.orderBy(F.desc("accuracy"))).alias("place"),
        "accuracy",
        "net_gain",
        (allowed & (first == 1)).alias("is_chosen"),
    )


def confidence_shares(truth: DataFrame, threshold: float) -> DataFrame:
    """One row: rows and shares of both bands."""
    high = F.count_if(F.col("confidence") >= threshold)
    n = F.count(F.lit(1))
    return truth.agg(
        n.alias("n"),
        high.alias("n_high"),
        (n - high).alias("n_low"),
        (high / n).alias("share_high"),
        ((n - high) / n).alias("share_low"),
    )


def corpus_profile(corpus: DataFrame) -> DataFrame:
    """One row: reports, classes, groups, and the most rows in one group."""
    cells = corpus.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = cells.groupBy("group_id").agg(F.sum("n").alias("n")).agg(F.max("n")).scalar()
    return cells.agg(
        F.sum("n").alias("n_reports"),
        F.countDistinct("label").alias("n_labels"),
        F.countDistinct("group_id").alias("n_groups"),
        largest.alias("max_per_group"),
    )


def summary(truth: DataFrame, preds: DataFrame, threshold: float) -> DataFrame:
    """One row for one model's (report_id, pred): totals and accuracies."""
    both = truth.join(preds.select("report_id", "pred"), "report_id")
    hit = F.coalesce(F.col("y_true") == F.col("pred"), F.lit(False)).cast("int")
    high = F.col("confidence") >= threshold
    return both.agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("overall_accuracy"),
        F.coalesce(F.avg(F.when(high, hit)), F.lit(0.0)).alias("high_confidence_accuracy"),
        F.coalesce(F.avg(F.when(~high, hit)), F.lit(0.0)).alias("low_confidence_accuracy"),
        F.count_if(high).alias("high_confidence_count"),
        F.count_if(~high).alias("low_confidence_count"),
    )


def _steps_reached(score: Column, steps: int) -> Column:
    """Largest i with i / steps <= score, exact for doubles: the product is
    only a first guess."""
    guess = F.floor(score * F.lit(float(steps))).cast("int")
    s = F.lit(float(steps))
    return (
        F.when((guess + 1) / s <= score, guess + 1).when(guess / s > score, guess - 1).otherwise(guess)
    )


def threshold_sweep(truth: DataFrame, preds: DataFrame, steps: int = 100) -> DataFrame:
    """threshold, n_above, coverage, accuracy_above, accuracy_below for every
    multiple of 1 / steps in [0, 1]. Rows are counted once into steps + 2
    buckets; the thresholds are running sums over the buckets."""
    reached = F.greatest(_steps_reached(F.col("confidence"), steps), F.lit(-1))
    buckets = (
        truth.join(preds.select("report_id", "pred"), "report_id")
        .groupBy(F.least(reached, F.lit(steps)).alias("step"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("y_true") == F.col("pred")).alias("hits"),
        )
    )
    grid = truth.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    filled = grid.join(buckets, "step", "left").na.fill(0, ["n", "hits"])
    downwards = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    sums = filled.select(
        "step",
        F.sum("n").over(downwards).alias("n_above"),
        F.sum("hits").over(downwards).alias("hits_above"),
        F.sum("n").over(everything).alias("n_all"),
        F.sum("hits").over(everything).alias("hits_all"),
    ).filter(F.col("step") >= 0)
    below = F.col("n_all") - F.col("n_above")
    return sums.select(
        (F.col("step") / F.lit(float(steps))).alias("threshold"),
        "n_above",
        F.when(F.col("n_all") > 0, F.col("n_above") / F.col("n_all")).alias("coverage"),
        F.when(F.col("n_above") > 0, F.col("hits_above") / F.col("n_above")).alias("accuracy_above"),
        F.when(below > 0, (F.col("hits_all") - F.col("hits_above")) / below).alias("accuracy_below"),
    )


def routed_accuracy(
    truth: DataFrame, preds: DataFrame, baseline: str, steps: int = 20
) -> DataFrame:
    """model, threshold, accuracy of a system that keeps the baseline's answer
    at or above the threshold and asks the model below it. The thresholds run
    from 0 (never ask) to beyond 1 (always ask)."""
    base = preds.filter(F.col("model") == baseline).select(
        "report_id", F.col("pred").alias("base_pred")
    )
    reached = F.least(
        F.greatest(_steps_reached(F.col("confidence"), steps), F.lit(-1)), F.lit(steps)
    )
    y = F.col("y_true")
    buckets = (
        truth.join(base, "report_id")
        .join(preds.filter(F.col("model") != baseline), "report_id")
        .groupBy("model", reached.alias("step"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("base_pred") == y).alias("base_hits"),
            F.count_if(F.col("pred") == y).alias("model_hits"),
        )
    )
    # steps + 3 thresholds per model; each bucket serves those it lies under.
    counts = buckets.groupBy("model").agg(
        F.sum("n").alias("n_all"),
        F.collect_list(F.struct("step", "base_hits", "model_hits")).alias("b"),
    )
    at = counts.select("model", "n_all", "b", F.explode(F.sequence(F.lit(0), F.lit(steps + 1))).alias("t"))
    hits = F.aggregate(
        "b",
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.when(x["step"] >= F.col("t"), x["base_hits"]).otherwise(x["model_hits"]),
    )
    return at.select(
        "model",
        (F.col("t") / F.lit(float(steps))).alias("threshold"),
        (hits / F.col("n_all")).alias("accuracy"),
    )
