"""Log rows unique by id for good, and rows that come too late kept apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

BUCKETS = 4_096


def first_predictions(
    log: DataFrame,
    key: str = "id",
    order: str = "created_at",
    also: Sequence[str] = (),
    keep_days: int = 400,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The log's columns and `status`: `first` for the first row of a key,
    `conflict` for a later one whose other columns differ; plain repeats are
    dropped. The state of a key is the key, a digest of the first row's columns
    (all but `order`, and those named in `also`) and the time of its last row. It
    goes once the log is keep_days past that; rows that lie still further behind
    the log's latest one are dropped, so no id passes twice (run_with_late_rows()
    keeps such rows). Rows of one batch are taken by `order`, ties by digest. Null
    keys have no identity: each is `first`.

    Keys are kept in hash buckets and judged a bucket at a time: a call of Python
    and a state for each key would cost milliseconds a key. The number of buckets
    is fixed by the checkpoint; take more where a bucket would hold millions."""
    compared = [c for c in log.columns if c not in (key, order, *also)]
    marked = log.withColumn("_digest", F.xxhash64(*compared) if compared else F.lit(0).cast("long"))
    name = F.col(key).cast("string")
    # A bucket of its own for each row without a key.
    bucket = F.pmod(F.xxhash64(name), F.lit(buckets)).cast("string")
    own = F.when(name.isNotNull(), F.concat(F.lit("k"), bucket)).otherwise(F.concat(F.lit("n"), F.expr("uuid()")))
    marked = marked.withColumn("_key", F.coalesce(name, F.lit(""))).withColumn("_bucket", own).withColumn("_ms", F.unix_millis(order))
    columns = log.columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema) + ", status string"

    def judged(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        seen = {k: (digest, last) for k, digest, last in zip(*state.get)} if state.exists else {}
        rows = None if state.hasTimedOut else pd.concat(list(frames))
        if rows is not None:
            rows = rows.sort_values([order, "_digest"], kind="stable")
            first = rows.drop_duplicates("_key").set_index("_key")["_digest"].to_dict()
            last = rows["_ms"].fillna(0).astype("int64").groupby(rows["_key"]).max().to_dict()
            status = []
            judge = {k: seen[k][0] for k in first if k in seen}
            for k, digest in zip(rows["_key"].tolist(), rows["_digest"].tolist()):
                held = judge.get(k)
                status.append("first" if held is None else "repeat" if digest == held else "conflict")
                judge.setdefault(k, digest)
            out = rows[columns].assign(status=status)
            yield out[out["status"] != "repeat"]
        else:
            last = {}
        # Keys of this batch stay; others go once the log has passed them.
        seen = {k: v for k, v in seen.items() if k in last or v[1] + 1 >= mark}
        seen |= {k: (judge[k], max(ms, mark)) for k, ms in last.items()}
        if not seen:
            state.remove()
            return
        state.update(([*seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]))
        state.setTimeoutTimestamp(max(min(v[1] for v in seen.values()), mark) + 1)

    return (
        marked.withWatermark(order, f"{keep_days} days")
        .groupBy("_bucket")
        .applyInPandasWithState(
            judged, shape, "keys array<string>, digests array<long>, last array<long>", "append", "EventTimeTimeout"
        )
    )


def run_with_late_rows(
    log: DataFrame,
    path: str,
    late: str,
    marks: str,
    checkpoint: str,
    lateness: str = "1 hour",
    order: str = "created_at",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Log rows in time at `path`, the others at `late` with the watermark they
    missed and how far they lie behind it. A batch's watermark is the latest
    `order` of the batches before it less `lateness`; each batch stores its own
    latest time at `marks`. All three are written by batch, and a batch looks at
    smaller batch numbers only, so one that is replayed decides as before and
    overwrites what it left. Rows without a time are late, for that reason."""
    spark = log.sparkSession

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        before = _latest(spark, marks, batch_id)
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        seen = batch.withColumn("watermark", mark).persist()
        try:
            behind = F.col(order).isNull() | F.coalesce(F.col(order) < F.col("watermark"), F.lit(False))
            seconds = F.unix_timestamp("watermark") - F.unix_timestamp(order)
            reason = F.when(F.col(order).isNull(), "no time").otherwise("behind the watermark")
            out = seen.filter(behind).withColumn("reason", reason).withColumn("seconds_behind", seconds)
            out.write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
            kept = seen.filter(~behind).drop("watermark")
            kept.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            seen.agg(F.max(order).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        finally:
            seen.unpersist()

    return (
        log.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _latest(spark: SparkSession, marks: str, batch_id: int):
    """The latest time of all batches before this one, or None."""
    try:
        rows = spark.read.schema("latest timestamp, batch_id long").parquet(marks)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
