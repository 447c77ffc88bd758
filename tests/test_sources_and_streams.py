import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluice.catalog import fixtures as fx
from sluice.plans import cascade
from sluice.session import StageStore, shared_dir
from sluice.sources import evaluation_store, labels, prediction_log
from sluice.sources import reports as files
from sluice.streaming import classify as sc
from sluice.streaming import metrics as sm


def test_csv_with_line_breaks_quotes_and_missing_values(spark, tmp_path):
    (tmp_path / "reports.csv").write_text(
        'patient_filename,text\nP1.A.txt,"two\nlines, ""quoted"""\nP2.B.txt,NA\nP3.C.txt,\nnodot,plain\n'
    )
    (tmp_path / "labels.csv").write_text("patient_id,cancer_type\nP1,BRCA\nP2,nan\n")
    got = {r.report_id: (r.group_id, r.text) for r in files.read_reports_csv(spark, str(tmp_path / "reports.csv")).collect()}
    assert got == {
        "P1.A.txt": ("P1", 'two\nlines, "quoted"'), "P2.B.txt": ("P2", None), "P3.C.txt": ("P3", None), "nodot": ("nodot", "plain"),
    }
    pairs = files.read_labels_csv(spark, str(tmp_path / "labels.csv")).collect()
    assert sorted((r.group_id, r.label) for r in pairs) == [("P1", "BRCA"), ("P2", None)]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,text,patient_filename\n1,hello,P1.A.txt\n")
    (tmp_path / "bad.csv").write_text("id,words\n1,hello\n")
    row = files.read_reports_csv(spark, str(tmp_path / "r.csv")).first()
    assert tuple(row) == ("P1.A.txt", "P1", "hello")
    with pytest.raises(ValueError):
        files.read_reports_csv(spark, str(tmp_path / "bad.csv"))


def test_missing_input_fails_before_any_job(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_reports(spark, str(tmp_path / "absent"), "a", "b")


def test_label_dimension(spark):
    dimension = labels.label_dimension(spark)
    assert dimension.count() == 32
    codes = dimension.select("code")
    named = labels.add_name(codes, dimension, "code", "shown")
    back = labels.add_code(named.select("shown"), dimension, "shown", "code")
    assert back.select("code").exceptAll(codes).count() == 0
    row = spark.createDataFrame([("OV",)], "c string").select(F.element_at(labels.name_map(labels.REPORT_LABELS), F.col("c")))
    assert row.first()[0] == labels.REPORT_LABELS["OV"]
    with pytest.raises(ValueError):
        labels.label_dimension(spark, {"A": "x", "B": "x"})


def log_frame(spark, ids):
    rows = [(i, "t", "A", "a", 0.5, "hybrid", "high", ["A", "B"], 5) for i in ids]
    return spark.createDataFrame(
        rows,
        "id string, report_text string, prediction string, prediction_label string, routing_score double, "
        "routed_to string, reliability string, top_k_candidates array<string>, latency_ms int",
    )


def test_log_appends_and_replays(spark, tmp_path):
    path = str(tmp_path / "log")
    assert prediction_log.read_log(spark, path).count() == 0
    prediction_log.append_predictions(log_frame(spark, ["1", "2"]), path)
    prediction_log.append_predictions(log_frame(spark, ["3"]), path)
    got = prediction_log.read_log(spark, path)
    assert sorted(r.id for r in got.collect()) == ["1", "2", "3"]
    assert got.filter("created_at is null").count() == 0
    batches = str(tmp_path / "batches")
    prediction_log.replace_batch(log_frame(spark, ["1", "2"]), batches, 0)
    prediction_log.replace_batch(log_frame(spark, ["3"]), batches, 1)
    prediction_log.replace_batch(log_frame(spark, ["1", "2"]), batches, 0)
    assert sorted(r.id for r in spark.read.parquet(batches).collect()) == ["1", "2", "3"]


def test_replay_after_midnight_and_append_after_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in ("2024-01-01 23:59:59", "2024-01-02 00:00:01"):
        rows = log_frame(spark, ["1", "2"]).withColumn("created_at", F.lit(day).cast("timestamp"))
        prediction_log.replace_batch(rows, path, 7)
    got = prediction_log.read_log(spark, path)
    assert sorted(r.id for r in got.collect()) == ["1", "2"]
    assert {str(r.created_date) for r in got.collect()} == {"2024-01-02"}
    prediction_log.append_predictions(log_frame(spark, ["3"]), path)
    assert sorted(r.id for r in prediction_log.read_log(spark, path).collect()) == ["1", "2", "3"]


def test_store_gives_each_call_a_table(store, spark):
    first, second = store.put("t", spark.range(2)), store.put("t", spark.range(5))
    assert (first.count(), second.count()) == (2, 5)


def test_evaluation_store(spark, tmp_path):
    path = str(tmp_path / "eval")
    assert evaluation_store.read_predictions(spark, path).count() == 0
    first = spark.createDataFrame([("m", "1", "a"), ("n", "1", "b")], "model string, report_id string, pred string")
    evaluation_store.upsert_predictions(first, path)
    evaluation_store.upsert_predictions(first.filter("model = 'm'").withColumn("pred", F.lit("z")), path)
    stored = evaluation_store.read_predictions(spark, path)
    assert sorted((r.model, r.pred) for r in stored.collect()) == [("m", "z"), ("n", "b")]
    wanted = spark.createDataFrame([("m", "1"), ("m", "2"), ("k", "1")], "model string, report_id string")
    assert sorted((r.model, r.report_id) for r in evaluation_store.pending(wanted, stored).collect()) == [("k", "1"), ("m", "2")]


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    assert StageStore(spark, "/x").base.startswith("/x/stages-")


def test_store_drops_its_own_tables_only(spark, tmp_path):
    kept, gone = StageStore(spark, str(tmp_path)), StageStore(spark, str(tmp_path))
    for s in (kept, gone):
        s.put("t", spark.range(3))
    gone.drop()
    assert [p.name for p in tmp_path.iterdir()] == [kept.base.rsplit("/", 1)[1]]
    assert kept.get("t", spark.range(1)).count() == 3


@pytest.fixture(scope="module")
def trained(spark, sf):
    return fx.training(spark, sf)


def test_stream_equals_batch_and_replays(spark, sf, trained, tmp_path):
    rows = fx.reports(spark, sf).select("report_id", "text").filter("report_id < 60")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("log", "rejects", "checkpoint")]

    def run():
        stream = sc.read_stream(spark, str(tmp_path / "in"), rows, maxFilesPerTrigger="2")
        sc.classify_stream(stream, trained.model, *paths, run_id="r").awaitTermination()

    run()
    batch = cascade.classify(rows, trained.model, StageStore(spark, str(tmp_path)), run_id="r")
    want = batch.results.select(F.col("prediction_id").alias("id"), "prediction", "routed_to")
    got = spark.read.parquet(paths[0])
    assert got.select("batch_id").distinct().count() == 2
    assert got.select("id", "prediction", "routed_to").exceptAll(want).count() == 0
    assert got.count() == want.count()
    assert spark.read.parquet(paths[1]).count() == batch.rejects.count() > 0
    run()  # nothing new: nothing is logged twice
    assert spark.read.parquet(paths[0]).count() == want.count()
    paths[2] = str(tmp_path / "lost")  # checkpoint lost: all batches run again
    run()
    assert spark.read.parquet(paths[0]).count() == want.count()


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


LOG = "id string, routed_to string, reliability string, latency_ms int, routing_score double, created_at timestamp"


def one_by_one(spark, folder, batches):
    """Each batch as one file, read in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/part")
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part")


def entry(i, minute):
    return (str(i), "hybrid", "high", i, 0.5, at(minute))


def test_late_rows_and_window_edges(spark, tmp_path):
    # The watermark of one batch filters from the batch after the next one on.
    batches = [
        [entry(1, 0), entry(2, 59), entry(3, 60)], [entry(4, 400)], [entry(8, 401)],
        [entry(5, 30), entry(6, 390)], [entry(7, 900)],
    ]
    stream = one_by_one(spark, tmp_path, batches)
    table = sm.windowed_metrics(stream, "1 hour", None, "1 hour")
    sm.run_to_table(table, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.window_start: r.total_requests for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    starts = {(s - min(got)).total_seconds() / 3600: n for s, n in got.items()}
    # 5 came after its window had closed; 6 was late but within the hour; the
    # window of 7 is still open.
    assert starts == {0.0: 2, 1.0: 1, 6.0: 3}


def test_repeated_ids(spark, tmp_path):
    batches = [[entry(1, 0), entry(1, 0), entry(2, 1)], [entry(1, 10), entry(3, 11)]]
    stream = one_by_one(spark, tmp_path, batches)
    sm.run_to_table(sm.unique_predictions(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_open_windows_are_stored_and_late_rows_counted(spark, tmp_path):
    batches = [[entry(1, 0), entry(2, 59), entry(4, 50)], [entry(3, 400)], [entry(8, 401)], [entry(5, 30)], [entry(7, 900)]]
    stream = one_by_one(spark, tmp_path, batches)
    table = sm.windowed_metrics(stream, "1 hour", None, "1 hour")
    query = sm.run_upserts(table, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = sm.latest_windows(spark, str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r.total_requests for r in got] == [3, 2, 1]
    assert got[0].p50_latency_ms == 2.0 and got[0].p95_latency_ms == 3.8
    assert sm.late_rows(query) == 1
