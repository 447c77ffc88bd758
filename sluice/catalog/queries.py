"""One query per operator, each over whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.catalog import fixtures as fx
from sluice.functions import answers, text
from sluice.operators import candidates as cand
from sluice.operators import centroids as cen
from sluice.operators import evaluation as ev
from sluice.operators import frequent_terms
from sluice.operators import joins, latency_sketches, linear_models, metrics, routing, scorers, splits, squared_hinge
from sluice.operators import vectors as vec
from sluice.operators import vocabulary as voc
from sluice.operators import windows as win
from sluice.params import REFERENCE_WINDOWS, CascadeParams
from sluice.plans import cascade, training
from sluice.session import StageStore
from sluice.sources import evaluation_store, labels, prediction_log
from sluice.sources import reports as report_files
from sluice.sources.evidence_lookup import save_evidence
from sluice.streaming import classify as stream_classify
from sluice.streaming import metrics as stream_metrics
from sluice.streaming import unique as stream_unique

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
P = fx.PARAMS
THRESHOLD = P.threshold


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(array) -> F.Column:
    return F.array_join(array, " ")


# --- sources and sinks ------------------------------------------------------


@query
def scan_reports(spark, d):
    path = f"{d}/documents.parquet"
    return report_files.read_reports(spark, path, "doc_id", "source")


@query
def scan_labels(spark, d):
    return fx.labels(spark, d)


@query
def csv_round_trip(spark, d):
    """All reports written as CSV in the reference's layout and read back."""
    path = StageStore(spark).path("reports_csv")
    name = F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".txt"))
    fx.table(spark, d, "documents").select(name.alias("patient_filename"), "text").write.option(
        "header", True
    ).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    back = report_files.read_reports_csv(spark, path)
    return back.select("report_id", "group_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _dimension(spark, d) -> DataFrame:
    parts = F.split("label", "-")
    name = F.concat(F.lit("documents in "), parts[0], F.lit(" of quality "), parts[1])
    return fx.labels(spark, d).select(F.col("label").alias("code"), name.alias("name")).distinct()


def _names(spark, d) -> dict[str, str]:
    rows = _dimension(spark, d).limit(P.max_labels + 1).collect()
    if len(rows) > P.max_labels:
        raise ValueError(f"more than {P.max_labels} classes")
    return {r.code: r.name for r in rows}


@query
def label_dimension(spark, d):
    """Every code with its display name and the way back from the name."""
    dimension = labels.label_dimension(spark, _names(spark, d))
    rows = fx.labels(spark, d).withColumnRenamed("label", "code")
    named = labels.add_name(rows, dimension, "code", "label_name")
    back = labels.add_code(named, dimension, "label_name", "code_again")
    return back.groupBy("code", "label_name", "code_again").agg(F.count(F.lit(1)).alias("n"))


@query
def label_names(spark, d):
    dimension = labels.label_dimension(spark, _names(spark, d))
    rows = fx.labels(spark, d).withColumnRenamed("label", "code")
    return labels.add_name(rows, dimension, "code", "label_name").select("report_id", "label_name")


@query
def label_codes(spark, d):
    dimension = labels.label_dimension(spark, _names(spark, d))
    rows = fx.labels(spark, d).withColumnRenamed("label", "code")
    named = labels.add_name(rows, dimension, "code", "label_name").drop("code")
    return labels.add_code(named, dimension, "label_name", "code").select("report_id", "code")


def _full_log(spark, d) -> DataFrame:
    return fx.prediction_log(spark, d).select(
        "id",
        F.concat(F.lit("report "), F.col("id")).alias("report_text"),
        F.col("routed_to").alias("prediction"),
        F.upper("routed_to").alias("prediction_label"),
        "routing_score",
        "routed_to",
        "reliability",
        F.array(F.col("routed_to"), F.lit("other")).alias("top_k_candidates"),
        "latency_ms",
        "created_at",
    )


@query
def append_prediction_log(spark, d):
    """Two appends into an absent log, read back."""
    path = prediction_log.log_path(StageStore(spark).base)
    log = _full_log(spark, d)
    prediction_log.append_predictions(log.filter(F.col("reliability") == "low"), path)
    prediction_log.append_predictions(log.filter(F.col("reliability") == "high"), path)
    return prediction_log.read_log(spark, path).select(
        "id",
        "prediction_label",
        "routing_score",
        "latency_ms",
        answers.encode_candidates(F.col("top_k_candidates")).alias("stored_candidates"),
        F.col("created_date").cast("string").alias("created_date"),
    )


@query
def saved_model_round_trip(spark, d):
    """Save, load, score all reports with both, count differing rows."""
    model = fx.training(spark, d).model
    path = StageStore(spark).path("model")
    model.save(path)
    again = cen.CentroidModel.load(spark, path)
    rows = fx.reports(spark, d)

    def decided(m):
        return cand.hard_prediction(cand.report_scores(rows, m), m.labels, P.tie_decimals)

    before, after = decided(model), decided(again)
    both = before.join(after.withColumnRenamed("prediction", "reloaded"), "report_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.count_if(~F.col("prediction").eqNullSafe(F.col("reloaded"))).alias("n_different"),
    )


def _stored_predictions(spark, d) -> tuple[str, DataFrame]:
    path = StageStore(spark).path("evaluation")
    evaluation_store.upsert_predictions(fx.predictions(spark, d), path)
    return path, evaluation_store.read_predictions(spark, path, "bigint")


@query
def read_evaluation_store(spark, d):
    return _stored_predictions(spark, d)[1].select("model", "report_id", "pred")


@query
def upsert_evaluation_store(spark, d):
    """model_b is run again; the other models' predictions stay."""
    path, _ = _stored_predictions(spark, d)
    again = fx.truth(spark, d).select(
        "report_id", F.col("y_true").alias("pred"), F.lit("model_b").alias("model")
    )
    evaluation_store.upsert_predictions(again, path)
    return evaluation_store.read_predictions(spark, path, "bigint").select("model", "report_id", "pred")


@query
def pending_predictions(spark, d):
    """model_a has answered the labelled reports only; what is left to do."""
    wanted = fx.predictions(spark, d).select("model", "report_id").filter(F.col("model") == "model_a")
    stored = fx.predictions(spark, d).join(fx.labels(spark, d).select("report_id"), "report_id", "left_semi")
    return evaluation_store.pending(wanted, stored)


# --- projections and predicates ---------------------------------------------


@query
def group_of_name(spark, d):
    name = F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".txt"))
    return fx.table(spark, d, "documents").select("doc_id", text.group_of(name).alias("group_id"))


@query
def drop_missing_labels(spark, d):
    rows = fx.reports(spark, d).join(fx.labels(spark, d), "report_id", "left")
    return rows.dropna(subset=["text", "label"]).select("report_id", "label")


@query
def request_check(spark, d):
    return fx.reports(spark, d).select("report_id", answers.reject_reason(F.col("text")).alias("reason"))


@query
def confidence_bands(spark, d):
    band = answers.confidence_band(F.col("confidence"), THRESHOLD)
    return fx.truth(spark, d).select("report_id", band.alias("band"))


@query
def focused_text(spark, d):
    excerpt = text.focus_text(F.col("text"), fx.ANCHORS)
    return fx.reports(spark, d).select("report_id", excerpt.alias("excerpt"))


@query
def candidate_names(spark, d):
    """Names of the classes of each report's candidates."""
    scores = fx.truth(spark, d)
    names = F.create_map(*[F.lit(x) for pair in (("en", "English"), ("fr", "French"), ("de", "German")) for x in pair])
    shown = answers.display_names(F.col("candidates"), names)
    return scores.select("report_id", F.array_join(shown, "; ").alias("names"))


_PROMPT = "Text:\n{report}\n\nOptions:\n{options}\n\nCode:"


@query
def fallback_prompts(spark, d):
    names = F.create_map(*[F.lit(x) for pair in (("en", "English"), ("fr", "French"), ("de", "German")) for x in pair])
    codes = F.array(F.lit("fr"), F.lit("en"), F.lit("de"))
    prompt = answers.build_prompt(F.col("text"), answers.option_list(codes, names), _PROMPT)
    return fx.reports(spark, d).select("report_id", prompt.alias("prompt"))


def _raw_answers(spark, d) -> DataFrame:
    """Answers as models give them, in seven spellings."""
    code, i = F.upper("lang"), F.col("doc_id") % 7
    raw = (
        F.when(i == 0, code)
        .when(i == 1, F.concat(F.lit(" "), F.col("lang"), F.lit("\n")))
        .when(i == 2, F.concat(code, F.lit(".")))
        .when(i == 3, F.concat(code, F.lit(" is it")))
        .when(i == 4, F.lit("XX"))
        .when(i == 5, F.lit("  \t"))
    )
    return fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("report_id"),
        raw.alias("raw"),
        F.array(F.lit("EN"), F.lit("FR"), F.lit("DE")).alias("candidates"),
    )


@query
def validated_answers(spark, d):
    answer = answers.validated_answer(F.col("raw"), F.col("candidates"))
    return _raw_answers(spark, d).select("report_id", answer.alias("answer"))


@query
def encoded_candidates(spark, d):
    stored = answers.encode_candidates(F.col("candidates"))
    second = answers.decode_candidates(F.col("stored"))[1]
    rows = fx.truth(spark, d).select("report_id", stored.alias("stored"))
    return rows.select("report_id", "stored", second.alias("second"))


@query
def prediction_ids(spark, d):
    return fx.reports(spark, d).select(
        "report_id", answers.prediction_id("run-1", F.col("report_id")).alias("prediction_id")
    )


@query
def selected_reports(spark, d):
    chosen = fx.table(spark, d, "labels").select(F.col("doc_id").alias("report_id"))
    return splits.select_reports(fx.reports(spark, d), chosen).select("report_id", "group_id")


# --- joins and splits -------------------------------------------------------


@query
def labelled_corpus(spark, d):
    rows = joins.labelled_corpus(fx.reports(spark, d), fx.labels(spark, d), "report_id")
    return rows.select("report_id", "group_id", "label", F.length("text").alias("n_chars"))


@query
def group_label_join(spark, d):
    """Reports joined to a label of their group, many rows to one, with hot
    groups spread; a group with two labels multiplies its reports."""
    marks = fx.labels(spark, d).join(fx.reports(spark, d).select("report_id", "group_id"), "report_id")
    group_labels = marks.groupBy("group_id").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")
    ).select("group_id", F.explode(F.array("lo", "hi")).alias("label"))
    rows = joins.labelled_corpus(fx.reports(spark, d), group_labels, "group_id")
    return rows.select("report_id", "group_id", "label")


@query
def duplicate_labels(spark, d):
    marks = fx.labels(spark, d).join(fx.reports(spark, d).select("report_id", "group_id"), "report_id")
    return joins.duplicate_label_keys(marks.select("group_id", "label"))


def _split(spark, d, validation_share=0.0) -> DataFrame:
    store = StageStore(spark)
    rows, marks = fx.reports(spark, d), fx.labels(spark, d)
    return training.split_corpus(rows, marks, P, store, "report_id", validation_share)


@query
def leakage_check(spark, d):
    return splits.leaked_groups(_split(spark, d))


@query
def aligned_predictions(spark, d):
    return joins.align(fx.truth(spark, d), fx.predictions(spark, d)).select(
        "model", "report_id", "y_true", "pred", "confidence"
    )


@query
def alignment_report(spark, d):
    """Predictions against the labelled reports only: some ids have no truth."""
    labelled = fx.labels(spark, d)
    some = fx.predictions(spark, d).join(
        fx.table(spark, d, "documents").filter(F.col("lang") != "fr").select(F.col("doc_id").alias("report_id")),
        "report_id", "left_semi",
    )
    return joins.alignment_report(labelled, some)


@query
def group_split(spark, d):
    return _split(spark, d).select("report_id", "group_id", "split")


@query
def validation_split(spark, d):
    return _split(spark, d, validation_share=0.2).select("report_id", "split")


@query
def split_report(spark, d):
    return splits.split_report(_split(spark, d))


@query
def fixed_subset(spark, d):
    """The reference's subset of 300 reports, drawn by hash."""
    return splits.subset(fx.reports(spark, d), 300, "report_id", P.seed).select("report_id")


@query
def stratified_folds(spark, d):
    return splits.stratified_folds(fx.labels(spark, d), 5, seed=P.seed).select("report_id", "label", "fold")


@query
def stratified_group_folds(spark, d):
    """Every group, its rows and in how many folds they are; for every label and
    fold, whether its rows are within the largest group of a fifth of them."""
    corpus = joins.labelled_corpus(fx.reports(spark, d), fx.labels(spark, d), "report_id")
    short = corpus.select("report_id", "group_id", "label")
    rows = StageStore(spark).put("folds", splits.stratified_group_folds(short, StageStore(spark)))
    groups = rows.groupBy(F.col("group_id").alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("fold").alias("n_folds"), F.lit(True).alias("balanced")
    )
    largest = rows.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = largest.groupBy("label").agg(F.max("n").alias("most"))
    cells = rows.groupBy("label").pivot("fold", list(range(5))).agg(F.count(F.lit(1))).na.fill(0)
    by_fold = F.array(*[F.col(str(f)) for f in range(5)])
    total = F.aggregate(by_fold, F.lit(0).cast("long"), lambda a, x: a + x)
    off = F.array_max(F.transform(by_fold, lambda n: F.abs(n - total / 5)))
    labels = cells.join(largest, "label").select(
        F.col("label").alias("name"),
        total.alias("n_rows"),
        F.lit(5).cast("long").alias("n_folds"),
        (off <= F.col("most") + 1).alias("balanced"),
    )
    return groups.unionByName(labels)


@query
def group_folds(spark, d):
    return splits.group_folds(fx.reports(spark, d), 5, seed=P.seed).select("report_id", "fold")


@query
def corpus_profile(spark, d):
    corpus = joins.labelled_corpus(fx.reports(spark, d), fx.labels(spark, d), "report_id")
    return ev.corpus_profile(corpus)


# --- text features ----------------------------------------------------------


@query
def word_tokens(spark, d):
    rows = fx.reports(spark, d).select("report_id", text.word_tokens(F.col("text")).alias("t"))
    return rows.select("report_id", F.size("t").alias("n_tokens"), F.md5(_joined("t")).alias("digest"))


@query
def stop_word_filter(spark, d):
    rows = fx.reports(spark, d).select("report_id", text.word_tokens(F.col("text")).alias("t"))
    kept = text.drop_stop_words(F.col("t"), P.stop_words)
    rows = rows.select("report_id", kept.alias("k"))
    return rows.select("report_id", F.size("k").alias("n_kept"), F.md5(_joined("k")).alias("digest"))


@query
def report_ngrams(spark, d):
    rows = voc.report_terms(fx.reports(spark, d), P)
    return rows.select(
        "report_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("digest")
    )


@query
def term_statistics(spark, d):
    documents = voc.report_terms(fx.reports(spark, d), P)
    return voc.term_statistics(documents).filter(F.col("df") >= P.min_df)


def _vocabulary(spark, d, max_features=P.max_features) -> DataFrame:
    documents = voc.report_texts(fx.reports(spark, d))
    params = CascadeParams(max_features=max_features)
    return voc.fit_vocabulary(documents, params, StageStore(spark))


@query
def vocabulary(spark, d):
    """The capped vocabulary with its inverse document frequencies."""
    return _vocabulary(spark, d).select("term", "tf", "df", F.round("idf", 6).alias("idf"))


@query
def vocabulary_cap(spark, d):
    """A cap that cuts through terms of equal frequency."""
    return _vocabulary(spark, d, max_features=5_000).select("term", "tf", "df")


@query
def frequent_vocabulary(spark, d):
    """The same by way of the Count-Min filter: most n-grams are never shuffled."""
    params = replace(P, max_features=5_000)
    documents = voc.report_terms(fx.reports(spark, d), params)
    return frequent_terms.frequent_vocabulary(documents, params, StageStore(spark), width=1 << 17).select(
        "term", "tf", "df", F.round("idf", 6).alias("idf")
    )


@query
def vocabulary_size(spark, d):
    return _vocabulary(spark, d).agg(F.count(F.lit(1)).alias("n_terms"))


@query
def vocabulary_match(spark, d):
    documents = voc.report_terms(fx.reports(spark, d), P)
    vocab = StageStore(spark).put("vocabulary", _vocabulary(spark, d))
    known = voc.match_vocabulary(documents, vocab, P.max_features)
    return known.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n_known"),
        F.sum("tf").alias("n_occurrences"),
        F.round(F.sum(F.col("tf") * F.col("idf")), 4).alias("weight"),
    )


@query
def tfidf_vectors(spark, d):
    """Per report: entries, sum and largest entry of the unit vector."""
    documents = voc.report_terms(fx.reports(spark, d), P)
    vocab = StageStore(spark).put("vocabulary", _vocabulary(spark, d))
    rows = vec.tfidf_rows(documents, vec.vectorizer(vocab, P))
    return rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.round(F.sum("w"), 4).alias("sum_w"),
        F.round(F.max("w"), 6).alias("max_w"),
    )


@query
def token_windows(spark, d):
    """Every window of every text."""
    rows = win.report_windows(fx.reports(spark, d), P)
    return rows.select(
        "report_id", "chunk_index", F.size("tokens").alias("n_tokens"), F.md5(win.window_text(F.col("tokens"))).alias("digest")
    )


@query
def token_windows_reference_cap(spark, d):
    """The window cap itself is the feature: at most 12 windows a report."""
    capped = win.report_windows(fx.reports(spark, d), CascadeParams(max_windows=REFERENCE_WINDOWS))
    return capped.select("report_id", "chunk_index", F.size("tokens").alias("n_tokens"))


@query
def window_coverage(spark, d):
    table = win.coverage(fx.reports(spark, d), P, limit=512, cap=12)
    return table.select(
        "n_reports",
        F.round("share_over_limit", 6).alias("share_over_limit"),
        F.round("share_over_cap", 6).alias("share_over_cap"),
        "tokens_over_cap",
        "n_windows",
    )


# --- stage 1 ----------------------------------------------------------------


@query
def class_weights(spark, d):
    return linear_models.class_weights(fx.labels(spark, d)).select(
        "label", "n", F.round("weight", 6).alias("weight")
    )


@query
def class_centroids(spark, d):
    """Per class: entries, sum and largest entry of the centroid."""
    rows = cen.centroid_rows(fx.training(spark, d).model)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.round(F.sum("w"), 4).alias("sum_w"),
        F.round(F.max("w"), 6).alias("max_w"),
    )


@query
def class_scores(spark, d):
    """All reports against all classes, as rows."""
    model = fx.training(spark, d).model
    documents = voc.report_terms(fx.reports(spark, d), P)
    vectors = model.vectorizer.transform(documents).select("report_id", "tfidf")
    scores = vec.class_scores(vec.vector_entries(vectors, "report_id"), model.weights, "report_id")
    return scores.select("report_id", "label", (F.round("score", 5) + 0.0).alias("score"))


def _candidates(spark, d):
    run = fx.training(spark, d)
    scores = cand.report_scores(fx.reports(spark, d), run.model)
    return run, cand.top_candidates(scores, run.model.labels, P.top_k, P.tie_decimals)


@query
def top_candidates(spark, d):
    _, found = _candidates(spark, d)
    return found.select("report_id", answers.encode_candidates(F.col("candidates")).alias("candidates"))


@query
def top_candidates_long(spark, d):
    """The same ranking from (report, label) rows."""
    model = fx.training(spark, d).model
    documents = voc.report_terms(fx.reports(spark, d), P)
    vectors = model.vectorizer.transform(documents).select("report_id", "tfidf")
    scores = vec.class_scores(vec.vector_entries(vectors, "report_id"), model.weights, "report_id")
    return cand.top_candidates_long(scores, P.top_k, P.tie_decimals).select("report_id", "rank", "label")


@query
def hard_predictions(spark, d):
    run = fx.training(spark, d)
    scores = cand.report_scores(fx.reports(spark, d), run.model)
    return cand.hard_prediction(scores, run.model.labels, P.tie_decimals)


@query
def candidate_recall(spark, d):
    run, found = _candidates(spark, d)
    held_out = run.part("test").select("report_id", F.col("label").alias("y_true"))
    return cand.candidate_recall(found, held_out, P.top_k).select("k", F.round("recall", 6).alias("recall"))


_FITTED: dict[tuple[str, int], training.Classifiers] = {}


def _classifiers(spark, d) -> training.Classifiers:
    """Both fitted models over the whole vocabulary of the training side, with
    language and quality as class. Trained once a session and input (by its
    digest, so a table that is written anew is trained on anew): the queries below look at the same models from different sides."""
    parts = [fx.reports(spark, d), fx.labels(spark, d)]
    digest = [p.agg(F.bit_xor(F.xxhash64(*p.columns))).first()[0] or 0 for p in parts]
    key = (spark.sparkContext.applicationId, hash(tuple(digest)))
    if key not in _FITTED:
        _FITTED[key] = training.train_classifiers(_split(spark, d), P, StageStore(spark), with_full=True)
    return _FITTED[key]


def _is_one(total) -> F.Column:
    return F.abs(total - 1.0) < 1e-9


def _sum(array) -> F.Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _best_label(labels, array) -> F.Column:
    names = F.array(*[F.lit(x) for x in labels])
    return F.element_at(names, F.array_position(array, F.array_max(array)).cast("int"))


@query
def logistic_regression(spark, d):
    """Every held-out report: probabilities add up to 1, the prediction is the
    best of them, and the fit has reached the optimum of its objective."""
    fitted = _classifiers(spark, d)
    model, held_out = fitted.logistic, fitted.part("test")
    gradient = linear_models.logistic_gradient(model, fitted.part("train"))
    return model.transform(held_out).select(
        "report_id",
        _is_one(_sum("probability")).alias("sums_to_one"),
        (F.col("prediction") == _best_label(model.labels, F.col("probability"))).alias("is_best"),
        F.lit(gradient < 1e-4).alias("is_optimal"),
    )


@query
def linear_svm(spark, d):
    """Every held-out report: one decision value a class, the best is predicted."""
    fitted = _classifiers(spark, d)
    model, held_out = fitted.svm.full, fitted.part("test")
    scores = StageStore(spark).put("scores", model.scores(held_out))
    decided = cand.hard_prediction(scores, model.labels, P.tie_decimals)
    rounded = F.transform("scores", lambda s: F.round(s, P.tie_decimals))
    return scores.join(decided, "report_id").select(
        "report_id",
        F.size("scores").alias("n_scores"),
        (F.col("prediction") == _best_label(model.labels, rounded)).alias("is_best"),
    )


@query
def calibrated_svm(spark, d):
    """Sigmoid calibration over 5 folds: probabilities add up to 1, the best is
    predicted, candidates rank by the first fold's raw scores."""
    fitted = _classifiers(spark, d)
    model, held_out = fitted.svm, fitted.part("test")
    store = StageStore(spark)
    probable = model.transform(held_out)
    scores = store.put("scores", model.decision_scores(held_out))
    ranked = model.candidates(held_out, 3, P.tie_decimals)
    order = cand.pick(cand.label_array(model.labels), cand.ranked_indices(F.col("scores"), 3, P.tie_decimals))
    return probable.join(ranked, "report_id").join(scores, "report_id").select(
        "report_id",
        _is_one(_sum("probability")).alias("sums_to_one"),
        (F.col("prediction") == _best_label(model.labels, F.col("probability"))).alias("is_best"),
        (F.col("candidates") == order).alias("ranks_by_score"),
    )


@query
def holdout_scores(spark, d):
    """Both fitted models on the test side: rows, and whether accuracy, macro
    and weighted F1 are those of a model that has learnt (above the share of
    the largest class)."""
    fitted = _classifiers(spark, d)
    truth, counts = fitted.part("test").select("report_id", "label"), fitted.counts
    largest = truth.groupBy("label").count().agg(F.max("count")).first()[0]
    table = ev.accuracy(counts, "model").join(ev.f1_scores(counts, "model"), "model")
    return table.select(
        "model",
        "n",
        (F.col("accuracy") * F.col("n") > largest).alias("beats_largest_class"),
        F.col("macro_f1").between(0.3, 1.0).alias("has_macro_f1"),
        F.col("weighted_f1").between(0.5, 1.0).alias("has_weighted_f1"),
    )


_SMALL_LABELS = ["a", "b", "c"]


def _small(spark, d) -> DataFrame:
    """report_id, label, fold, tfidf: two features of the embeddings, three
    classes, some of them mislabelled. Small enough for SQL to fit it too."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(2)]
    label = F.when(F.col("vec_id") % 11 == 0, "c").when(e[0] > 0.05, "a").when(e[1] > 0.05, "b").otherwise("c")
    rows = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("report_id"),
        label.alias("label"),
        (F.col("vec_id") % 5).cast("int").alias("fold"),
        array_to_vector(F.array(*[16.0 * x for x in e])).alias("tfidf"),
    )
    return StageStore(spark).put("small", rows)


def _to_5(column, name: str) -> F.Column:
    return F.round(column, 5).alias(name)


@query
def squared_hinge_svm(spark, d):
    """Weights and objective of each class, for each of five folds left out and
    for all rows (-1), fitted in the same passes."""
    solved = squared_hinge.fit_squared_hinge(
        _small(spark, d), _SMALL_LABELS, [0, 1, 2, 3, 4, None], StageStore(spark), tolerance=1e-11
    )
    rows = [
        (-1 if p.fold is None else p.fold, _SMALL_LABELS[p.label], *map(float, solved.weights[:, i]), float(f))
        for i, (p, f) in enumerate(zip(solved.problems, solved.objective))
    ]
    shape = "fold int, label string, w0 double, w1 double, intercept double, objective double"
    numbers = ("w0", "w1", "intercept", "objective")
    return spark.createDataFrame(rows, shape).select("fold", "label", *[_to_5(F.col(c), c) for c in numbers])


def _small_calibrated(spark, d) -> tuple[linear_models.CalibratedSvm, DataFrame]:
    rows = _small(spark, d)
    return linear_models.fit_calibrated(rows, StageStore(spark), 5, with_full=True, tolerance=1e-11), rows


@query
def sigmoid_calibration(spark, d):
    """Slope and intercept of each fold and class."""
    model, _ = _small_calibrated(spark, d)
    rows = [(f, c, *ab) for f, (_, sig) in enumerate(model.folds) for c, ab in zip(_SMALL_LABELS, sig)]
    return spark.createDataFrame(rows, "fold int, label string, slope double, intercept double").select(
        "fold", "label", _to_5(F.col("slope"), "slope"), _to_5(F.col("intercept"), "intercept")
    )


@query
def calibrated_probabilities(spark, d):
    """Probabilities averaged over the folds, the best of them, its class."""
    model, rows = _small_calibrated(spark, d)
    each = [_to_5(F.col("probability")[i], f"p_{c}") for i, c in enumerate(_SMALL_LABELS)]
    return model.transform(rows).select(
        "report_id", "prediction", _to_5(F.col("best_probability"), "best_probability"), *each
    )


@query
def fold_decisions(spark, d):
    """Decision values of the first fold's SVM, by which candidates are ranked."""
    model, rows = _small_calibrated(spark, d)
    scores = StageStore(spark).put("scores", model.decision_scores(rows))
    decided = cand.hard_prediction(scores, model.labels, P.tie_decimals).select("report_id", "prediction")
    each = [_to_5(F.col("scores")[i], f"s_{c}") for i, c in enumerate(_SMALL_LABELS)]
    return scores.join(decided, "report_id").select("report_id", *each, "prediction")


@query
def calibrated_quality(spark, d):
    """Accuracy and macro F1 of the calibrated SVM, as figures."""
    model, rows = _small_calibrated(spark, d)
    truth = rows.select("report_id", "label")
    counts = linear_models.holdout_scores(model.transform(rows), truth, "svm")
    table = ev.accuracy(counts, "model").join(ev.f1_scores(counts, "model"), "model")
    return table.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query
def saved_svm_round_trip(spark, d):
    """Save and load the calibrated SVM and the logistic model, score every
    held-out report with both, count differing rows."""
    fitted = _classifiers(spark, d)
    model, logistic, held_out = fitted.svm, fitted.logistic, fitted.part("test")
    path = StageStore(spark).path("models")
    fitted.save(path)
    _, logistic_again, again = training.load_classifiers(spark, path)
    pairs = [
        (model.transform(held_out), again.transform(held_out)),
        (logistic.transform(held_out), logistic_again.transform(held_out)),
        (
            cand.hard_prediction(model.decision_scores(held_out, "full"), model.labels, P.tie_decimals),
            cand.hard_prediction(again.decision_scores(held_out, "full"), again.labels, P.tie_decimals),
        ),
    ]
    rows = None
    for before, after in pairs:
        both = before.select("report_id", "prediction").join(
            after.select("report_id", F.col("prediction").alias("reloaded")), "report_id", "left"
        )
        rows = both if rows is None else rows.unionByName(both)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("prediction").eqNullSafe(F.col("reloaded"))).alias("n_different"),
    )


@query
def classify_svm(spark, d):
    """The cascade with the calibrated SVM as Stage 1: its candidates are the
    SVM's own best classes, in order, and the answer is one of them."""
    fitted = _classifiers(spark, d)

    def stage1(reports):
        documents = fitted.vectorizer.transform(voc.report_terms(reports, P))
        return fitted.svm.candidates(documents, P.top_k, P.tie_decimals)

    rows = fx.reports(spark, d)
    done = cascade.classify(rows, fx.training(spark, d).model, StageStore(spark), stage1=stage1)
    own = stage1(rows).withColumnRenamed("candidates", "own")
    return done.results.join(own, "report_id").select(
        "report_id",
        (F.col("top_k_candidates") == F.col("own")).alias("ranks_by_svm"),
        F.array_contains("top_k_candidates", F.col("prediction")).alias("is_candidate"),
    )


@query
def vector_centroids(spark, d):
    """The centroid operator on ready-made dense vectors: entries that are not 0."""
    vectors = fx.table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("tfidf"),
    )
    rows = cen.class_centroids(vectors, StageStore(spark)).withColumnRenamed("idx", "pos")
    return rows.select("label", "n_rows", "pos", (F.round("w", 4) + 0.0).alias("w"))


# --- stage 2 ----------------------------------------------------------------


def _stages(spark, d):
    run = fx.training(spark, d)
    store = StageStore(spark)
    rows = fx.reports(spark, d)
    return run, store, rows, cascade.run_stages(rows, run.model, store)


@query
def window_candidates(spark, d):
    _, found = _candidates(spark, d)
    windows = win.report_windows(fx.reports(spark, d), P)
    return win.window_candidates(windows, found)


@query
def window_evidence(spark, d):
    _, _, _, stages = _stages(spark, d)
    return stages.evidence.select("report_id", "chunk_index", "top_label", F.round("score", 4).alias("score"))


@query
def window_probabilities(spark, d):
    """The softmax over the candidates of each window, as rows."""
    _, _, _, stages = _stages(spark, d)
    pairs = F.posexplode(F.arrays_zip("candidates", "probabilities")).alias("pos", "e")
    return stages.evidence.select("report_id", "chunk_index", pairs).select(
        "report_id",
        "chunk_index",
        F.col("e.candidates").alias("label"),
        F.round("e.probabilities", 4).alias("probability"),
    )


@query
def best_windows(spark, d):
    _, _, _, stages = _stages(spark, d)
    return stages.decisions.select("report_id", "hybrid_label", F.round("score", 4).alias("score"))


@query
def explanations(spark, d):
    run, _, rows, stages = _stages(spark, d)
    told = win.explain(rows, stages.evidence, P)
    texts = F.array_join(F.transform("chunk_evidence", lambda e: e["chunk_text"]), "|")
    tops = F.array_join(F.transform("chunk_evidence", lambda e: e["top_label"]), ",")
    return told.select(
        "report_id", F.size("chunk_evidence").alias("n_windows"), F.md5(texts).alias("texts"), tops.alias("labels")
    )


@query
def evidence_by_id(spark, d):
    """What the 100 least certain decisions rest on, looked up by report id in
    the stored evidence."""
    _, _, rows, stages = _stages(spark, d)
    name = f"evidence_{uuid.uuid4().hex}"
    stored = save_evidence(rows, stages.evidence, name, 16, StageStore(spark).path("lookup"))
    asked = stages.decisions.orderBy(F.round("score", 4), "report_id").select("report_id").limit(100)
    told = stored.of([r.report_id for r in asked.collect()], P).withColumn("e", F.explode_outer("chunk_evidence"))
    return told.select(
        "report_id",
        F.col("e.chunk_index").alias("chunk_index"),
        F.md5("e.chunk_text").alias("chunk_text"),
        F.col("e.top_label").alias("top_label"),
        F.round("e.score", 4).alias("score"),
    )


def _code_scorer(windows):
    def hits(label):
        code = F.lower(F.substring_index(label, "-", 1))
        return (F.size("tokens") - F.size(F.array_remove("tokens", code))).cast("double")

    scored = F.transform(
        "candidates", lambda c: F.struct(c.alias("label"), hits(c).alias("raw_score"))
    )
    rows = windows.select("report_id", "chunk_index", scored.alias("s"))
    return rows.select("report_id", "chunk_index", F.inline_outer("s"))


@query
def own_window_scorer(spark, d):
    """A caller's window scorer: how often the candidate's language code
    occurs among the window's words."""
    _, found = _candidates(spark, d)
    evidence = win.own_evidence(fx.reports(spark, d), found, _code_scorer, P)
    return evidence.select("report_id", "chunk_index", "top_label", F.round("score", 4).alias("score"))


# --- routing ----------------------------------------------------------------


@query
def threshold_routing(spark, d):
    _, _, _, stages = _stages(spark, d)
    kept, low = routing.split_by_threshold(stages.decisions, THRESHOLD)
    return kept.select("report_id", F.lit("hybrid").alias("routed_to")).unionByName(
        low.select("report_id", F.lit("fallback").alias("routed_to"))
    )


@query
def fallback_window_mean(spark, d):
    run, store, _, stages = _stages(spark, d)
    _, low = routing.split_by_threshold(stages.decisions, THRESHOLD)
    scorer = scorers.get_backend("window_mean").make(scorers.Context(run.model, stages.evidence))
    return routing.fallback_answers(low, scorer, P.retries, store).select("report_id", "answer", "was_valid")


@query
def fallback_focused_text(spark, d):
    run, store, rows, stages = _stages(spark, d)
    _, low = routing.split_by_threshold(stages.decisions, THRESHOLD)
    scorer = scorers.focused(fx.ANCHORS, 2000)(scorers.Context(run.model, stages.evidence))
    asked = low.join(rows.select("report_id", "text"), "report_id")
    return routing.fallback_answers(asked, scorer, P.retries, store).select("report_id", "answer", "was_valid")


@query
def fallback_retry(spark, d):
    """Answers in seven spellings; the second attempt repairs one of them."""
    rows = _raw_answers(spark, d)
    low = rows.select("report_id", "candidates")

    def scorer(asked, attempt):
        again = F.when((F.col("report_id") % 7 == 2) & (F.lit(attempt) > 0), F.regexp_replace("raw", r"\.", ""))
        return asked.join(rows.select("report_id", "raw"), "report_id").select(
            "report_id", F.coalesce(again, "raw").alias("raw")
        )

    return routing.fallback_answers(low, scorer, P.retries, StageStore(spark)).drop("error")


@query
def python_scorer(spark, d):
    """A Python model behind the scorer hook, run on the low rows only."""
    def answer(report, codes, attempt):
        return codes[len(report) % len(codes)]

    base = fx.truth(spark, d).withColumnRenamed("confidence", "score")
    upper = F.transform("candidates", lambda c: F.upper(c))
    rows = base.join(fx.reports(spark, d).select("report_id", "text"), "report_id").withColumn("candidates", upper)
    _, low = routing.split_by_threshold(rows, THRESHOLD)
    scorer = scorers.python_scorer(answer)
    return routing.fallback_answers(low, scorer, P.retries, StageStore(spark)).select("report_id", "answer")


@query
def classify_reports(spark, d):
    """The whole cascade over all reports, with the response columns."""
    model = fx.training(spark, d).model
    done = cascade.classify(fx.reports(spark, d), model, StageStore(spark), run_id="run-1")
    return done.results.select(
        "report_id",
        "prediction_id",
        "prediction",
        "routing_score",
        "routed_to",
        "reliability",
        answers.encode_candidates(F.col("top_k_candidates")).alias("top_k_candidates"),
    )


@query
def classify_reference_cap(spark, d):
    """The cascade with the reference's own cap of 12 windows a report."""
    model = fx.training(spark, d, CascadeParams(max_windows=REFERENCE_WINDOWS)).model
    done = cascade.classify(fx.reports(spark, d), model, StageStore(spark))
    return done.results.select("report_id", "prediction", "routed_to")


@query
def classify_repeated(spark, d):
    """A third of the reports twice, a seventh with a second text under the
    same id: every row is answered or rejected with a reason."""
    rows = fx.reports(spark, d).select("report_id", "text")
    again = rows.filter("report_id % 3 = 0")
    other = rows.filter("report_id % 7 = 1 and length(text) >= 20").withColumn(
        "text", F.concat("text", F.lit(" and more"))
    )
    model = fx.training(spark, d).model
    done = cascade.classify(rows.unionByName(again).unionByName(other), model, StageStore(spark))
    return done.results.select("report_id", F.col("prediction").alias("outcome")).unionByName(
        done.rejects.select("report_id", F.col("reason").alias("outcome"))
    )


@query
def classify_own_candidates(spark, d):
    """Candidates of the caller, one of them no class of the model."""
    def stage1(reports):
        even = F.array(F.lit("EN-1"), F.lit("XX-9"), F.lit("FR-1"))
        odd = F.array(F.lit("DE-1"), F.lit("XX-9"))
        return reports.select("report_id", F.when(F.col("report_id") % 2 == 0, even).otherwise(odd).alias("candidates"))

    model = fx.training(spark, d).model
    done = cascade.classify(fx.reports(spark, d), model, StageStore(spark), stage1=stage1)
    return done.results.select("report_id", "prediction", "routed_to")


@query
def scorer_errors(spark, d):
    """A fallback that fails on some rows: these are rejected with its error,
    the others answered."""
    def answer(report, codes, attempt):
        if len(report) % 5 == 0:
            raise ValueError("refused")
        return codes[-1]

    scorers.register_backend("fragile", lambda context: scorers.python_scorer(answer))
    model = fx.training(spark, d).model
    done = cascade.classify(fx.reports(spark, d), model, StageStore(spark), "fragile")
    return done.results.select("report_id", F.col("prediction").alias("outcome")).unionByName(
        done.rejects.select("report_id", F.col("reason").alias("outcome"))
    )


@query
def batch_totals(spark, d):
    model = fx.training(spark, d).model
    return cascade.batch_totals(cascade.classify(fx.reports(spark, d), model, StageStore(spark)))


@query
def cascade_quality(spark, d):
    """Accuracy by confidence band on the held-out groups."""
    run, store, rows, stages = _stages(spark, d)
    held_out = run.part("test").select("report_id", F.col("label").alias("y_true"))
    decided = stages.decisions.select("report_id", F.col("score").alias("confidence"), F.col("hybrid_label").alias("pred"))
    facts = held_out.join(decided.select("report_id", "confidence"), "report_id")
    table = ev.summary(facts, decided, THRESHOLD)
    return table.select(
        "total_reports",
        "high_confidence_count",
        "low_confidence_count",
        *[F.round(c, 6).alias(c) for c in ("overall_accuracy", "high_confidence_accuracy", "low_confidence_accuracy")],
    )


@query
def validation_sweep(spark, d):
    """Coverage and accuracy by threshold on the validation groups, which
    neither the model nor the test side has seen: where to choose it."""
    run = fx.training(spark, d, validation_share=0.2)
    stages = cascade.run_stages(fx.reports(spark, d), run.model, StageStore(spark))
    seen = run.part("validation").select("report_id", F.col("label").alias("y_true"))
    facts = seen.join(stages.decisions.select("report_id", F.round("score", 6).alias("confidence")), "report_id")
    decided = stages.decisions.select("report_id", F.col("hybrid_label").alias("pred"))
    table = ev.threshold_sweep(facts, decided, 20)
    return _rounded(table, "threshold", "coverage", "accuracy_above", "accuracy_below")


@query
def threshold_change(spark, d):
    _, _, _, stages = _stages(spark, d)
    return routing.threshold_change(stages.decisions, THRESHOLD, 0.5)


@query
def rerouted_reports(spark, d):
    """Routing again at 0.5 from stored stages."""
    run, store, _, stages = _stages(spark, d)
    again = cascade.route(stages, run.model, store, threshold=0.5)
    return again.select("report_id", "prediction", "routed_to")


# --- log metrics ------------------------------------------------------------


@query
def log_metrics(spark, d):
    return metrics.log_metrics(fx.prediction_log(spark, d))


@query
def log_metrics_empty(spark, d):
    """A kind of event that does not occur: one row of zeros."""
    none = fx.prediction_log(spark, d).filter(F.col("routed_to") == "absent")
    return metrics.log_metrics(none)


@query
def log_metrics_by(spark, d):
    table = metrics.log_metrics_by(fx.prediction_log(spark, d))
    return table.withColumn("day", F.col("day").cast("string"))


@query
def latency_percentiles(spark, d):
    return metrics.latency_percentiles(fx.prediction_log(spark, d), ["routed_to"])


@query
def sketched_percentiles(spark, d):
    """Percentiles of latencies with fractions, by backend and overall, from
    stored sketches of each day and backend; one day is stored twice."""
    events = fx.table(spark, d, "events")
    log = events.select(F.to_date("ts").alias("day"), F.col("event_type").alias("routed_to"), "value")
    path = StageStore(spark).path("sketches")
    made = latency_sketches.latency_sketches(log, ["day", "routed_to"], "value", k=32_768)
    latency_sketches.store_sketches(made, path)
    latency_sketches.store_sketches(made.filter("day = DATE'2024-01-05'"), path)
    stored = latency_sketches.read_sketches(spark, path)
    by_backend = latency_sketches.rolled_up(stored, ["routed_to"], k=32_768)
    whole = latency_sketches.rolled_up(stored, k=32_768).withColumn("routed_to", F.lit("all"))
    return by_backend.unionByName(whole)


# --- evaluation -------------------------------------------------------------


def _counts(spark, d):
    counts = ev.evaluation_counts(fx.truth(spark, d), fx.predictions(spark, d), fx.BASELINE, THRESHOLD)
    return StageStore(spark).put("counts", counts)


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query
def model_accuracy(spark, d):
    return _rounded(ev.accuracy(_counts(spark, d), "model"), "accuracy")


@query
def f1_scores(spark, d):
    return _rounded(ev.f1_scores(_counts(spark, d), "model"), "macro_f1", "weighted_f1")


@query
def confusion_matrix(spark, d):
    return ev.confusion(_counts(spark, d))


@query
def confusion_pivot(spark, d):
    counts = _counts(spark, d)
    seen = counts.select(F.explode(F.array("y_true", "pred")).alias("label")).distinct()
    return ev.confusion_pivot(counts, sorted(r.label for r in seen.dropna().collect()))


@query
def per_class_scores(spark, d):
    return _rounded(ev.class_scores_table(_counts(spark, d), "model"), "precision", "recall", "f1")


@query
def model_comparison(spark, d):
    table = ev.comparison(_counts(spark, d), fx.BASELINE)
    return _rounded(table, "share", "accuracy", "macro_f1", "delta")


@query
def recovery(spark, d):
    return ev.recovery(_counts(spark, d), fx.BASELINE)


@query
def subset_comparison(spark, d):
    """model_s answered the labelled reports only."""
    some = fx.labels(spark, d).select("report_id")
    extra = fx.predictions(spark, d).filter(F.col("model") == "model_a").join(some, "report_id", "left_semi")
    preds = fx.predictions(spark, d).unionByName(extra.withColumn("model", F.lit("model_s")))
    truth, store = fx.truth(spark, d), StageStore(spark)
    table = ev.subset_comparison(truth, preds, "model_s", fx.BASELINE, THRESHOLD, store)
    return _rounded(table, "base_accuracy", "accuracy", "macro_f1", "delta")


@query
def model_availability(spark, d):
    return ev.availability(fx.registry(spark), fx.predictions(spark, d))


@query
def best_local_model(spark, d):
    return _rounded(ev.best_local(_counts(spark, d), fx.registry(spark), fx.BASELINE), "accuracy")


@query
def model_ranking(spark, d):
    return _rounded(ev.ranking(_counts(spark, d), fx.registry(spark), fx.BASELINE), "accuracy")


@query
def confidence_shares(spark, d):
    return _rounded(ev.confidence_shares(fx.truth(spark, d), THRESHOLD), "share_high", "share_low")


def _base(spark, d):
    return fx.predictions(spark, d).filter(F.col("model") == fx.BASELINE)


@query
def evaluation_summary(spark, d):
    table = ev.summary(fx.truth(spark, d), _base(spark, d), THRESHOLD)
    return _rounded(table, "overall_accuracy", "high_confidence_accuracy", "low_confidence_accuracy")


@query
def threshold_sweep(spark, d):
    table = ev.threshold_sweep(fx.truth(spark, d), _base(spark, d), 100)
    return _rounded(table, "threshold", "coverage", "accuracy_above", "accuracy_below")


@query
def routed_accuracy(spark, d):
    table = ev.routed_accuracy(fx.truth(spark, d), fx.predictions(spark, d), fx.BASELINE, 20)
    return _rounded(table, "threshold", "accuracy")


# --- streaming --------------------------------------------------------------


def _event_stream(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    like = fx.table(spark, d, "events")
    return fx.as_log(stream_classify.table_stream(spark, f"{d}/events.parquet", like))


@query
def stream_classify_reports(spark, d):
    """A stream of all reports, classified and logged once it has drained."""
    model = fx.training(spark, d).model
    store = StageStore(spark)
    like = fx.table(spark, d, "documents")
    rows = stream_classify.table_stream(spark, f"{d}/documents.parquet", like).select(
        F.col("doc_id").alias("report_id"), "text"
    )
    stream_classify.classify_stream(
        rows, model, store.path("log"), store.path("rejects"), store.path("checkpoint"), "run-1"
    ).awaitTermination()
    return spark.read.parquet(store.path("log")).select("id", "prediction", "routed_to", "reliability")


@query
def stream_unique_predictions(spark, d):
    """The log with every event sent twice, logged once."""
    store = StageStore(spark)
    log = _event_stream(spark, d).select("id", "routed_to", "reliability", "created_at")
    twice = log.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    stream_metrics.run_to_table(
        stream_metrics.unique_predictions(twice), store.path("unique"), store.path("checkpoint")
    )
    return spark.read.parquet(store.path("unique")).select("id", "routed_to", "reliability")


def _windowed(spark, d, slide):
    store = StageStore(spark)
    table = stream_metrics.windowed_metrics(_event_stream(spark, d), "1 day", slide)
    stream_metrics.run_upserts(table, store.path("windows"), store.path("checkpoint")).awaitTermination()
    done = stream_metrics.latest_windows(spark, store.path("windows"))
    return done.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        *[c for c in done.columns if not c.startswith("window_")],
    )


def _sent_again(spark, d, *parts) -> DataFrame:
    """A stream of the log's rows, part after part, each one micro-batch."""
    store, files = StageStore(spark), 4
    for part in parts:
        part.repartition(files).write.mode("append").parquet(store.path("in"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(store.path("in"))


@query
def stream_first_predictions(spark, d):
    """Every row sent again two days later, a tenth with another backend: ids
    stay unique, differing repeats are reported."""
    log = fx.prediction_log(spark, d).select("id", "routed_to", "latency_ms", "created_at")
    other = F.when(F.col("id").cast("long") % 10 == 0, "other").otherwise(F.col("routed_to"))
    later = F.col("created_at") + F.expr("INTERVAL 2 DAYS")
    again = log.withColumn("routed_to", other).withColumn("created_at", later)
    rows, store = stream_unique.first_predictions(_sent_again(spark, d, log, again)), StageStore(spark)
    stream_metrics.run_to_table(rows, store.path("first"), store.path("checkpoint"))
    return spark.read.parquet(store.path("first")).groupBy("status", "routed_to").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_late_rows(spark, d):
    """A seventh of the first half of the log arrives after the second half:
    it goes to the table of late rows, with how far it lies behind."""
    log = fx.prediction_log(spark, d).select("id", "routed_to", "created_at")
    early = F.col("created_at") < F.lit("2024-01-15").cast("timestamp")
    held_back = early & (F.col("id").cast("long") % 7 == 0)
    parts = [log.filter(early & ~held_back), log.filter(~early), log.filter(held_back)]
    store = StageStore(spark)
    paths = [store.path(x) for x in ("log", "late", "marks", "checkpoint")]
    stream_unique.run_with_late_rows(_sent_again(spark, d, *parts), *paths, "1 day").awaitTermination()
    logged = spark.read.parquet(paths[0]).select("routed_to", F.lit("logged").alias("kind"), F.lit(0).alias("s"))
    late = spark.read.parquet(paths[1]).select("routed_to", F.col("reason").alias("kind"), F.col("seconds_behind").alias("s"))
    return logged.unionByName(late).groupBy("kind", "routed_to").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("seconds_behind")
    )


@query
def stream_daily_metrics(spark, d):
    """Every day of the log, the last one too, which is still open."""
    return _windowed(spark, d, None)


@query
def stream_sliding_metrics(spark, d):
    return _windowed(spark, d, "6 hours")
