"""Centroid clustering: dimension-sharded Lloyd.

Vectors become integers floor(scale * x), so that every sum is exact and no
order of adding changes a result. They are stored once as blocks of rows, cut
into shards of `width` columns. The centroids are cut alike: a slice is what one
shard knows of them. A round is

  column-block tasks  each (block, shard) row meets its shard's slice only and
                      gives the partial squared distances to every centroid;
  reduce by block     the partial distances of a block's shards are added, the
                      nearest centroid taken (ties: the smaller number), and the
                      block's columns summed by cluster, shard by shard;
  update by shard     each shard adds these sums and replaces its own slice by
                      floor(sum / count); empty clusters keep theirs.

Only partial distances and narrow columns are shuffled, once a round; sums are
combined before their shuffle, which has shards x clusters rows a task. Slices
are joined by broadcast while all of them stay under SLICE_BYTES, else by a
salted shuffle. A block is a bounded number of bytes whatever the number of
clusters. Slices are stage tables, so no round is computed twice.

The first centroids are the `k` vectors with the smallest SHA-256 (hexadecimal)
of "<seed>:<id>", in that order; equal hashes, which repeated ids have, follow
the vector's components.

Defined cases: vectors that are null, of another length than `dims`, or hold a
null or non-finite component take no part and are not in the result. A null id
stays null and hashes as "<seed>:". Rows that repeat an id, or a vector, are
rows of their own. With fewer than k vectors there are as many centroids as
vectors. Components so large that a squared distance could leave 64 bits are an
error. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.grid import grid_rows, narrow, product, widen
from sluice.session import StageStore

CLUSTERS, ROUNDS, SCALE, DIMS, SEED = 40, 5, 256.0, 64, 2
WIDTH = 32  # columns in a shard
BLOCK_BYTES = 1 << 19  # partial distances, and columns, of a block
SLICE_BYTES = 64 << 20  # all slices, if they are broadcast
SALTS = 64

_BLOCK = "block long, shard int, n int, x binary, ids array<long>"
_PARTIAL = "block long, shard int, n int, x binary, d binary"
_SUMS = "shard int, cluster int, n long, sums array<long>"
_ASSIGNED = "vec_id long, cluster int, distance long"


def _shards(dims: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, dims)) for a in range(0, dims, width)]


def _valid(vector: str, dims: int) -> F.Column:
    finite = F.forall(
        F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.col(vector).isNotNull() & (F.size(vector) == dims) & finite


def _first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, seed: int) -> np.ndarray:
    """k rows reach the driver, as many as the model has."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.filter(_valid("v", dims)).orderBy(name, "v").limit(k).select("v").collect()
    lists = pa.array([r.v for r in rows], pa.list_(pa.float64()))
    return next((m for _, m in grid_rows(lists, scale)), np.empty((0, dims), np.int64))


def clustered(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: float = SCALE,
    seed: int = SEED,
    width: int = WIDTH,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    store = StageStore(spark)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )
    shards = _shards(dims, width)
    at_once = max(16, block_bytes // (8 * max(k, min(width, dims))))

    def cut(batches):
        count = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("vec_id")
            for places, matrix in grid_rows(batch.column("v"), scale):
                if matrix.shape[1] != dims:
                    continue
                for start in range(0, len(places), at_once):
                    part = matrix[start : start + at_once]
                    own = ids.take(pa.array(places[start : start + at_once])).to_pylist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([count] * len(shards), pa.int64()),
                            "shard": pa.array(range(len(shards)), pa.int32()),
                            "n": pa.array([len(part)] * len(shards), pa.int32()),
                            "x": pa.array([narrow(part[:, a:b]).tobytes() for a, b in shards], pa.binary()),
                            "ids": pa.array([own] + [None] * (len(shards) - 1), pa.list_(pa.int64())),
                        }
                    )
                    count += 1

    blocks = store.put("blocks", rows.mapInArrow(cut, _BLOCK))
    first = _first_centroids(rows, k, dims, scale, seed)
    slices = spark.createDataFrame(
        [(s, c, first[c, a:b].tolist()) for s, (a, b) in enumerate(shards) for c in range(len(first))],
        "shard int, cluster int, c array<long>",
    )
    small = 8 * k * dims <= slice_bytes

    def partial(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = shards[r["shard"]]
                x = widen(r["x"], r["n"] * (b - a)).reshape(r["n"], b - a)
                c = np.array(r["centroids"], np.int64).reshape(-1, b - a)
                d = (x * x).sum(axis=1)[:, None] - 2 * product(x, c) + (c * c).sum(axis=1)
                yield pa.RecordBatch.from_pylist(
                    [r | {"d": narrow(d).tobytes()}], pa.schema(_arrow_fields(r))
                )

    def beside(columns: list[str]) -> DataFrame:
        """Partial distances of every (block, shard) row, by its own slice."""
        own = slices.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("s"))
        own = own.select("shard", F.col("s.c").alias("centroids"))
        if small:
            met = blocks.join(F.broadcast(own), "shard")
        else:
            salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
            met = met.join(salted, ["shard", "salt"])
        shape = _PARTIAL + (", ids array<long>" if "ids" in columns else "")
        return met.select(*columns, "centroids").mapInArrow(partial, shape)

    def nearest(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n = table.column("n")[0].as_py()
        total = 0
        for d in table.column("d").to_pylist():
            total = total + widen(d, n * len(first)).reshape(n, -1)
        cluster = total.argmin(axis=1)  # the smallest number of equally near ones
        return cluster, total[np.arange(n), cluster]

    def sums(table: pa.Table) -> pa.Table:
        cluster, _ = nearest(table)
        order = np.argsort(cluster, kind="stable")
        found, starts = np.unique(cluster[order], return_index=True)
        counts = np.diff(np.append(starts, len(order)))
        out = []
        for s, x in zip(table.column("shard").to_pylist(), table.column("x").to_pylist()):
            a, b = shards[s]
            m = widen(x, len(cluster) * (b - a)).reshape(-1, b - a)[order]
            out += [
                {"shard": s, "cluster": c, "n": n, "sums": t}
                for c, n, t in zip(found.tolist(), counts.tolist(), np.add.reduceat(m, starts).tolist())
            ]
        return pa.Table.from_pylist(
            out,
            pa.schema(
                [("shard", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]
            ),
        )

    def assigned(table: pa.Table) -> pa.Table:
        cluster, distance = nearest(table)
        ids = next(i for i in table.column("ids").to_pylist() if i is not None)
        return pa.table(
            {
                "vec_id": pa.array(ids, pa.int64()),
                "cluster": pa.array(cluster, pa.int32()),
                "distance": pa.array(distance, pa.int64()),
            }
        )

    for step in range(rounds):
        added = beside(["block", "shard", "n", "x"]).groupBy("block").applyInArrow(sums, _SUMS)
        columns = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(min(width, dims))]
        added = added.groupBy("shard", "cluster").agg(F.sum("n").alias("n"), *columns)
        # Exact floor: pmod is the remainder of a floored division.
        means = F.array(*[F.expr(f"(s{j} - pmod(s{j}, n)) div n") for j in range(min(width, dims))])
        fresh = added.select("shard", "cluster", means.alias("fresh"))
        moved = slices.join(fresh, ["shard", "cluster"], "left").select(
            "shard",
            "cluster",
            F.coalesce(F.slice("fresh", F.lit(1), F.size("c")), "c").alias("c"),
        )
        slices = store.put(f"slices_{step}", moved)

    done = beside(["block", "shard", "n", "x", "ids"]).groupBy("block").applyInArrow(assigned, _ASSIGNED)
    done = store.put("assigned", done)
    spread = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = slices.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("shard", "c"))).alias("parts"))
    numbers = F.transform(F.flatten("parts.c"), lambda x: x.cast("string"))
    named = whole.select("cluster", F.sha2(F.array_join(numbers, ","), 256).alias("centroid_sha256"))
    per_cluster = spread.join(named, "cluster").withColumn("inertia", done.agg(F.sum("distance")).scalar())
    # One row for each cluster: as many as the model has centroids.
    return done.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _arrow_fields(row: dict) -> list[tuple[str, pa.DataType]]:
    kinds = {"block": pa.int64(), "shard": pa.int32(), "n": pa.int32(), "x": pa.binary(), "d": pa.binary()}
    return [*kinds.items(), *([("ids", pa.list_(pa.int64()))] if "ids" in row else [])]
