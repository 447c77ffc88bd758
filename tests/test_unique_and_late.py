"""Ids unique for good, conflicting repeats, and late rows as a table."""

import datetime as dt

from pyspark.sql import functions as F

from sluice.streaming import unique

LOG = "id string, routed_to string, latency_ms int, created_at timestamp"


def at(hours):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hours)


def add(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(df, tmp_path):
    query = (
        df.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def test_first_rows_and_conflicts_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    add(spark, folder, [("a", "x", 1, at(1)), ("a", "x", 1, at(0)), ("b", "y", 2, at(0)), (None, "z", 3, at(0))])
    query = drained(unique.first_predictions(stream(spark, folder)), tmp_path)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    # Two days later, after a restart: a repeat, a conflict, a new id, no id.
    add(spark, folder, [("a", "x", 1, at(48)), ("b", "other", 2, at(49)), ("c", "x", 5, at(48)), (None, "z", 3, at(48))])
    drained(unique.first_predictions(stream(spark, folder)), tmp_path)
    add(spark, folder, [("c", "x", 5, at(99)), ("c", "x", 6, at(99))])
    query = drained(unique.first_predictions(stream(spark, folder)), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "status", "latency_ms").collect() if r.id)
    assert got == [("a", "first", 1), ("b", "conflict", 2), ("b", "first", 2), ("c", "conflict", 6), ("c", "first", 5)]
    assert spark.read.parquet(str(tmp_path / "out")).filter("id IS NULL AND status = 'first'").count() == 2
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 5


def test_many_ids_share_few_states(spark, tmp_path):
    """Keys are judged a bucket at a time, and each goes once the log has passed it."""
    folder, hours = tmp_path / "in", 24 * 3
    add(spark, folder, [(f"id{i}", "x", i, at(0)) for i in range(300)])
    query = drained(unique.first_predictions(stream(spark, folder), keep_days=1, buckets=4), tmp_path)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    again = [(f"id{i}", "y" if i % 3 == 0 else "x", i, at(2)) for i in range(0, 300, 2)]
    add(spark, folder, [*again, ("id1000", "x", 0, at(hours))])
    drained(unique.first_predictions(stream(spark, folder), keep_days=1, buckets=4), tmp_path)
    add(spark, folder, [("id7", "z", 7, at(hours)), ("id1000", "z", 0, at(hours))])
    drained(unique.first_predictions(stream(spark, folder), keep_days=1, buckets=4), tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("status = 'first'").count() == 302  # id7 is new again, its state has gone
    conflicts = sorted(r.id for r in out.filter("status = 'conflict'").select("id").collect())
    assert conflicts == sorted([*(f"id{i}" for i in range(0, 300, 6)), "id1000"])


def test_late_rows_after_a_restart_and_a_replay(spark, tmp_path):
    folder, paths = tmp_path / "in", [str(tmp_path / p) for p in ("log", "late", "marks", "cp")]

    def run(checkpoint=paths[3]):
        unique.run_with_late_rows(stream(spark, folder), *paths[:3], checkpoint, "1 hour").awaitTermination()

    add(spark, folder, [("a", "x", 1, at(0)), ("b", "x", 1, at(10))])
    add(spark, folder, [("c", "x", 1, at(8)), ("d", "x", 1, at(9.5)), ("e", "x", 1, None)])
    run()
    add(spark, folder, [("f", "x", 1, at(30)), ("g", "x", 1, at(9))])
    add(spark, folder, [("h", "x", 1, at(28.5))])

    def state():
        log, late = spark.read.parquet(paths[0]), spark.read.parquet(paths[1])
        return sorted(r.id for r in log.collect()), sorted((r.id, r.reason, r.seconds_behind) for r in late.collect())

    run()
    want = (["a", "b", "d", "f", "g"], [("c", "behind the watermark", 3600), ("e", "no time", None), ("h", "behind the watermark", 1800)])
    assert state() == want
    run(str(tmp_path / "lost"))  # every batch again: the same decisions, in place
    assert state() == want
    assert spark.read.parquet(paths[0]).count() + spark.read.parquet(paths[1]).count() == 8
    assert spark.read.parquet(paths[2]).agg(F.max("latest")).first()[0] is not None
