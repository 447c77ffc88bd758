"""Hard-negative mining with an STR-packed R-tree.

Vectors become integers floor(scale * x); a score is an exact integer inner
product, ties go to the smaller id. An anchor's positives are the best rows of
its own label; its negatives, for each positive, the best rows of other labels
whose score lies in a window below the positive's.

Index. Rows are dealt by range of their first coordinates (ties by id, so equal
vectors don't meet in one task) and tiled in each task by Sort-Tile-Recursive:
sorted by the widest coordinate, cut into slabs, each slab by the next one, down
to leaves of LEAF rows. Leaves are packed into trees of at most TREE rows. The
box of a node gives, coordinate by coordinate, an interval for an anchor's inner
product with whatever lies in it.

Search. A best-first queue over all trees of a task pops the node with the
largest upper bound. A node is skipped if for each window its interval lies
outside the window or strictly below the kth score found; popping ends when that
holds for all that is left. Equal to kth isn't skipped, since ids decide ties.

Packs of trees (PACK_BYTES) meet blocks of anchors (BLOCK_BYTES) in one shuffle;
both sides of a task are bounded, nothing is broadcast or sent to the driver, and
a pack sends at most k rows for each anchor and window. The best of all packs are
taken by a ranking whose groups have k rows a pack. In many even dimensions boxes
overlap every window; then every leaf is scored, as brute force would.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part. Vectors of different lengths are not compared. Rows that
repeat an id, or a vector, are rows of their own; only the anchor's own row is
left out. Components so large that sums could leave 64 bits are an error. An
anchor without positives, or a positive without negatives in its window, gives no
row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import pieces
from sluice.llm.grid import grid_rows, narrow, product, widen
from sluice.session import StageStore

SCALE, POSITIVES, NEGATIVES = 256.0, 5, 5
LOW, HIGH = (80, 100), (100, 100)  # shares of the positive's score, as fractions
LEAF, FANOUT, TREE = 128, 8, 2_048
PACK_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20
_NONE = np.iinfo(np.int64).min

_POINT = "uid long, id long, label long, asks boolean, dims int, x binary, at long"
_TREE = "dims int, n int, size long, x binary, ids binary, uids binary, labels binary, leaves binary"
_HIT = "anchor long, slot int, score long, id long, uid long"


# --- index ------------------------------------------------------------------


def tiles(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Sort-Tile-Recursive: row numbers of the points, leaf by leaf."""
    spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(points.shape[1])
    axes = np.argsort(-spread, kind="stable").tolist()

    def tiled(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        if len(rows) <= leaf:
            return [rows]
        leaves = math.ceil(len(rows) / leaf)
        left = min(len(axes) - depth, 1 + int(math.log2(leaves)))
        slabs = leaves if left <= 1 else math.ceil(leaves ** (1 / left))
        if left > 0:
            rows = rows[np.argsort(points[rows, axes[depth]], kind="stable")]
        if left <= 1:
            return [rows[a : a + leaf] for a in range(0, len(rows), leaf)]
        size = leaf * math.ceil(leaves / slabs)
        return [t for a in range(0, len(rows), size) for t in tiled(rows[a : a + size], depth + 1)]

    return tiled(np.arange(len(points)), 0)


def _packed(points: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray) -> list[dict]:
    """Trees, as rows of a table, over the rows of one length."""
    leaves = tiles(points, LEAF)
    trees, held = [], []
    for i, leaf in enumerate(leaves):
        held.append(leaf)
        if i + 1 == len(leaves) or sum(map(len, held)) + len(leaves[i + 1]) > TREE:
            rows = np.concatenate(held)
            x = narrow(points[rows]).tobytes()
            trees.append(
                {
                    "dims": points.shape[1],
                    "n": len(rows),
                    "size": len(x) + 24 * len(rows),
                    "x": x,
                    "ids": ids[rows].tobytes(),
                    "uids": uids[rows].tobytes(),
                    "labels": labels[rows].tobytes(),
                    "leaves": np.array([len(t) for t in held], np.int64).tobytes(),
                }
            )
            held = []
    return trees


class _Trees:
    """The trees of a pack that have one length of vectors, with their boxes.
    Node numbers: leaves first, then parents, so a node's place says its kind."""

    def __init__(self, rows: list[dict]) -> None:
        read = lambda name: np.concatenate([np.frombuffer(r[name], np.int64) for r in rows])
        dims = rows[0]["dims"]
        self.points = np.concatenate([widen(r["x"], r["n"] * dims).reshape(r["n"], dims) for r in rows])
        self.ids, self.uids, self.labels = read("ids"), read("uids"), read("labels")
        sizes = read("leaves")
        stops = np.cumsum(sizes)
        self.spans = list(zip((stops - sizes).tolist(), stops.tolist()))
        self.low = [self.points[a:b].min(axis=0) for a, b in self.spans]
        self.high = [self.points[a:b].max(axis=0) for a, b in self.spans]
        # Labels of a node: the one label all its rows have, else none.
        self.only = [self._single(self.labels[a:b]) for a, b in self.spans]
        self.children: list[list[int]] = [[] for _ in self.spans]
        self.roots: list[int] = []
        at = 0
        for r in rows:
            level = list(range(at, at + len(r["leaves"]) // 8))
            at += len(level)
            while len(level) > 1:
                level = [self._parent(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
            self.roots += level
        self.low, self.high = np.array(self.low), np.array(self.high)

    @staticmethod
    def _single(labels: np.ndarray) -> int | None:
        return int(labels[0]) if (labels == labels[0]).all() else None

    def _parent(self, level: list[int]) -> int:
        self.low.append(np.min([self.low[i] for i in level], axis=0))
        self.high.append(np.max([self.high[i] for i in level], axis=0))
        same = {self.only[i] for i in level}
        self.only.append(same.pop() if len(same) == 1 else None)
        self.children.append(level)
        return len(self.children) - 1

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return (
            product(up, self.low) + product(down, self.high),
            product(up, self.high) + product(down, self.low),
        )


# --- search -----------------------------------------------------------------


class _Best:
    """The k best (score, id, uid) of a window [least, most]."""

    def __init__(self, k: int, least: int, most: int) -> None:
        self.k, self.least, self.most = k, least, most
        self.bar = least  # nothing strictly below can enter
        self.rows: list[tuple[int, int, int]] = []

    def offer(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.bar) & (scores <= self.most))
        if not len(fits):
            return
        if len(fits) > 4 * self.k:  # the kth best of these bounds what can enter
            kth = np.partition(scores[fits], len(fits) - self.k)[len(fits) - self.k]
            fits = fits[scores[fits] >= kth]
        new = zip((-scores[fits]).tolist(), ids[fits].tolist(), uids[fits].tolist())
        self.rows = heapq.nsmallest(self.k, [*self.rows, *new])
        if len(self.rows) == self.k:
            self.bar = max(self.least, -self.rows[-1][0])


def search(
    trees: _Trees, anchor: np.ndarray, low: list, high: list, label: int, uid: int, same: bool, best: list[_Best]
) -> None:
    """Best-first: fill `best` with rows of the anchor's label (same) or of
    other labels. low, high: the bounds of this anchor for each node."""

    def useful(node: int) -> bool:
        only = trees.only[node]
        if only is not None and (only == label) != same:
            return False
        return any(low[node] <= b.most and high[node] >= b.bar for b in best)

    queue = [(-high[root], root) for root in trees.roots if useful(root)]
    heapq.heapify(queue)
    while queue:
        upper, node = heapq.heappop(queue)
        if all(-upper < b.bar for b in best):
            return
        if not useful(node):
            continue
        for child in trees.children[node]:
            if useful(child):
                heapq.heappush(queue, (-high[child], child))
        if not trees.children[node]:
            a, b = trees.spans[node]
            fits = (trees.labels[a:b] == label) == same
            if same:
                fits &= trees.uids[a:b] != uid
            scores = trees.points[a:b][fits] @ anchor
            for window in best:
                window.offer(scores, trees.ids[a:b][fits], trees.uids[a:b][fits])


def _found(trees: list[dict], anchors: list[dict], k: int, same: bool) -> pa.Table:
    out: list[tuple[int, int, int, int, int]] = []
    for dims in {t["dims"] for t in trees} & {a["dims"] for a in anchors}:
        index = _Trees([t for t in trees if t["dims"] == dims])
        own = [a for a in anchors if a["dims"] == dims]
        for start in range(0, len(own), 1_000):
            part = own[start : start + 1_000]
            points = np.array([widen(a["x"], dims) for a in part]).reshape(len(part), dims)
            lows, highs = index.bounds(points)
            for a, point, low, high in zip(part, points, lows.tolist(), highs.tolist()):
                windows = a.get("windows") or [{"slot": 0, "least": _NONE, "most": -(_NONE + 1)}]
                best = [_Best(k, w["least"], w["most"]) for w in windows]
                search(index, point, low, high, a["label"], a["uid"], same, best)
                for w, b in zip(windows, best):
                    out += [(a["uid"], w["slot"], -s, i, u) for s, i, u in b.rows]
    columns = list(zip(*out)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["anchor", "slot", "score", "id", "uid"]
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


# --- Spark ------------------------------------------------------------------


def _met(trees: DataFrame, anchors: DataFrame, packs: int, blocks: int, k: int, same: bool) -> DataFrame:
    """The k best of each anchor and window from each pack, then of all packs."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        return _found(left.to_pylist(), right.to_pylist(), k, same)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = trees.withColumn("block", every(blocks)).groupBy("pack", "block")
    right = anchors.withColumn("pack", every(packs)).groupBy("pack", "block")
    hits = left.cogroup(right).applyInArrow(probe, _HIT)
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "uid")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: tuple[int, int] = LOW,
    high: tuple[int, int] = HIGH,
    scale: float = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    pack_bytes: int = PACK_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. low = (a, b): a negative's score is at least a/b of the
    positive's; high likewise at most. is_anchor is a condition on the id."""
    spark = rows.sparkSession
    store = StageStore(spark)
    plain = rows.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter("id is not null and label is not null and v is not null")
    plain = plain.withColumn("uid", F.monotonically_increasing_id())

    def quantized(batches):
        for batch in batches:
            for places, matrix in grid_rows(batch.column("v"), scale):
                own = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("uid"),
                        own.column("id"),
                        own.column("label"),
                        own.column("asks"),
                        pa.array(np.full(len(places), matrix.shape[1], np.int32)),
                        pa.array([narrow(r).tobytes() for r in matrix], pa.binary()),
                        pa.array(matrix[:, 0] if matrix.shape[1] else np.zeros(len(places), np.int64)),
                    ],
                    names=["uid", "id", "label", "asks", "dims", "x", "at"],
                )

    points = store.put("points", plain.mapInArrow(quantized, _POINT))

    def indexed(batches):
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                matrix = np.array([widen(x, dims) for x in own.column("x").to_pylist()]).reshape(len(own), dims)
                ids, uids, labels = (own.column(c).to_numpy() for c in ("id", "uid", "label"))
                yield pa.RecordBatch.from_pylist(_packed(matrix, ids, uids, labels), _tree_schema())

    size = points.agg(F.sum(F.octet_length("x") + 24)).first()[0] or 0
    slabs = pieces(size, 4 * pack_bytes, spark.sparkContext.defaultParallelism)
    dealt = points.repartitionByRange(slabs, "dims", "at", "uid").sortWithinPartitions("dims", "at")
    trees = store.put("trees", dealt.select("uid", "id", "label", "dims", "x").mapInArrow(indexed, _TREE))
    packs = pieces(size, pack_bytes, 2 * spark.sparkContext.defaultParallelism)
    trees = trees.withColumn("pack", F.pmod(F.xxhash64("ids", "uids"), F.lit(packs)).cast("int"))

    asking = points.filter("asks").select("uid", "id", "label", "dims", "x")
    asked = asking.agg(F.sum(F.octet_length("x") + 64 * positives)).first()[0] or 0
    blocks = pieces(asked, block_bytes)
    asking = asking.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))

    good = store.put("positives", _met(trees, asking, packs, blocks, positives, True))
    score = F.col("score")
    # ceil(a * p / b) and floor(a * p / b) in whole numbers
    least = F.expr(f"-((-{low[0]} * score - pmod(-{low[0]} * score, {low[1]})) div {low[1]})")
    most = F.expr(f"({high[0]} * score - pmod({high[0]} * score, {high[1]})) div {high[1]}")
    window = F.struct(F.col("rank").alias("slot"), least.alias("least"), most.alias("most"))
    windows = good.groupBy("anchor").agg(F.collect_list(window).alias("windows"))
    armed = asking.join(windows, F.col("uid") == F.col("anchor")).drop("anchor")
    bad = _met(trees, armed, packs, blocks, negatives, False)
    named = asking.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    positive = good.select(
        "anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), score.alias("positive_score")
    )
    return bad.join(positive, ["anchor", "slot"]).join(named, "anchor").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _tree_schema() -> pa.Schema:
    kinds = {"dims": pa.int32(), "n": pa.int32(), "size": pa.int64()}
    return pa.schema([*kinds.items(), *[(c, pa.binary()) for c in ("x", "ids", "uids", "labels", "leaves")]])
