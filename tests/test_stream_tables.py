"""A table as a stream: one file, or a folder of files."""

from sluice.streaming import classify, metrics


def test_a_table_of_many_files_is_streamed_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i)) for i in range(20)], "id int, name string")
    rows.repartition(3).write.parquet(str(tmp_path / "log.parquet"))
    rows.limit(1).write.parquet(str(tmp_path / "other.parquet"))
    one = next((tmp_path / "log.parquet").glob("part-*.parquet"))
    for table, n in ((tmp_path / "log.parquet", 20), (one, spark.read.parquet(str(one)).count())):
        out = tmp_path / f"out{n}"
        found = classify.table_stream(spark, str(table), rows)
        metrics.run_to_table(found, str(out), str(tmp_path / f"cp{n}"))
        assert spark.read.parquet(str(out)).count() == n
