"""Misra-Gries summaries: frequent keys of a stream in a bounded table."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKETCH = "fold int, sketch binary"


def trimmed(counts: Counter, size: int) -> Counter:
    """At most `size` keys: the count of the first key left out is taken off
    every count. A key of more than n / (size + 1) rows always stays."""
    if len(counts) <= size:
        return counts
    ranked = counts.most_common(size + 1)
    cut = ranked[size][1]
    return Counter({k: c - cut for k, c in ranked[:size] if c > cut})


def merged(sketches: Iterable[bytes], size: int) -> Counter:
    total: Counter = Counter()
    for one in sketches:
        total.update(pickle.loads(one))
        total = trimmed(total, 2 * size)
    return trimmed(total, size)


def frequent(df: DataFrame, column: str, size: int, keys_of, folds: int = 32) -> Counter:
    """Frequent keys of a column over all rows. keys_of turns an Arrow column
    into keys. Each task sends one summary of at most `size` keys; summaries
    meet in `folds` groups, then on the driver, so what the driver gets doesn't
    grow with the rows. Counts are lower bounds; callers verify them."""

    def local(batches):
        counts: Counter = Counter()
        fold = None
        for batch in batches:
            counts.update(keys_of(batch.column(column)))
            if len(counts) > 8 * size:
                counts = trimmed(counts, 2 * size)
            fold = batch.column("fold")[0].as_py() if fold is None and batch.num_rows else fold
        if fold is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold], pa.int32()), pa.array([pickle.dumps(trimmed(counts, size))])],
                names=["fold", "sketch"],
            )

    def together(table: pa.Table) -> pa.Table:
        whole = merged(table.column("sketch").to_pylist(), size)
        return pa.table({"fold": table.column("fold")[:1], "sketch": [pickle.dumps(whole)]})

    fold = F.pmod(F.spark_partition_id(), F.lit(folds)).cast("int").alias("fold")
    local_sketches = df.select(column, fold).mapInArrow(local, _SKETCH)
    few = local_sketches.groupBy("fold").applyInArrow(together, _SKETCH)
    return merged((bytes(r.sketch) for r in few.collect()), size)
