"""MinHash near-dedup with tensored banding.

Two documents are linked if the Jaccard similarity of their sets of distinct
word shingles reaches a threshold; a group is a connected component of links.

Tensored banding. A row of the table of hash tables would need its own MinHashes;
here `collections` small collections of `depth` MinHashes each are computed, and
every pair of collections forms the key of one table. 20 collections of 3 give
190 tables whose keys have 6 MinHashes, from 60 MinHashes instead of 1,140. Two
documents meet if at least two collections agree. At a similarity of 0.8 a
collection agrees with probability 0.512, so 1.3 in 100,000 such pairs don't
meet, at 0.85 2 in 10 million, and a chain of other links joins those as well;
documents of similarity 0.03 meet with probability 1.4e-7. For a corpus of n
documents take depth so that 190 * n * 0.03 ** (2 * depth) stays below 1: 3 up
to some ten million, 4 up to ten billion.

Equal sets are one node, so copies cost nothing. Each batch of nodes first joins
those that share a key inside it, so of a key that very many nodes share a batch
sends one row; keys are packed in bucket blocks. A bucket gives one spanning
forest of who shares any of its keys, never pairs; it sorts its keys part by part. The components of these forests, the clusters,
hold every candidate pair. Only the sets of clustered nodes move: clusters up to
UNIT_BYTES are dealt into tasks whole, larger ones are cut into parts, and every
two parts of one cluster meet in a unit of their own. There, in order of size, a
document is compared with those of the sizes that can match and that aren't yet
connected to it: the exact size of the intersection comes from bit rows over the
shingles that two or more of the unit have. A unit sends a spanning forest of
the links it confirmed, and Spark joins the components.

Shingles are compared by 64-bit hashes. Only sets that met are compared, so a
false match needs a collision within a pair: 1e-14 for a pair of 300 each.

Defined cases: A-Z is lower-cased; words are [^\\x20\\x09-\\x0D]+. A text of
fewer words than `width` has one shingle, the whole sequence; a null text or one
without words has none, and is linked with nothing. Null ids are larger than any
other id and come back as null; rows that repeat an id are rows of their own. An
empty table gives an empty result. Other columns are not read. A text is held as
a whole by one task, with 8 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import NO_ID, WordHashes, byte_texts, pieces, rolling_hashes, slices
from sluice.llm.simhash import components
from sluice.session import StageStore

WIDTH, SHARE = 2, (80, 100)
COLLECTIONS, DEPTH = 20, 3
BUCKET_BYTES, UNIT_BYTES, TASK_BYTES = 24 << 20, 4 << 20, 16 << 20
SUBS = 16  # a bucket's keys are sorted in so many parts, one at a time
BROADCAST_ROWS = 4_000_000
HOT_KEYS = 1_000
_WORDS = WordHashes()
_ROW = "doc_id long, n_shingles long, digest binary, bands binary, shingles binary"
_BLOCK = "bucket int, sub int, keys binary, nodes binary"


# --- sets and keys ----------------------------------------------------------


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling_hashes(_WORDS.of(words), min(width, len(words))))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return odd, rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)


def bands(sets: list[np.ndarray], collections: int, depth: int) -> np.ndarray:
    """One hash for each collection of MinHashes of each set (none empty)."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    odd, mask = _multipliers(collections * depth)
    out = np.zeros((len(sets), collections), np.uint64)
    for c in range(collections):
        for k in range(c * depth, (c + 1) * depth):
            least = np.minimum.reduceat((flat ^ mask[k]) * odd[k], starts)
            least ^= least >> np.uint64(32)
            out[:, c] = (out[:, c] ^ least) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def tensored(rows: np.ndarray) -> np.ndarray:
    """The key of every pair of collections, with the pair's number mixed in."""
    first, second = np.triu_indices(rows.shape[1], 1)
    pair = np.arange(1, len(first) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (rows[:, first] * np.uint64(0xD6E8FEB86659FD93) ^ rows[:, second]) + pair
    key ^= key >> np.uint64(31)
    key *= np.uint64(0x9E3779B97F4A7C15)
    return key ^ key >> np.uint64(32)


# --- links inside a task ----------------------------------------------------


class _Forest:
    """Union-find over places, with the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def sharing(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forest of the nodes that share a key, as pairs of nodes; the places of
    one row of each key)."""
    order = np.lexsort((nodes, keys))
    ranked, owner = keys[order], nodes[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.empty(0, bool)
    same = np.flatnonzero(~fresh)
    return forest_of(np.stack([owner[same - 1], owner[same]], axis=1)), order[fresh]


def forest_of(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs of nodes that make a spanning forest."""
    pairs = np.unique(pairs, axis=0)
    named, where = np.unique(pairs, return_inverse=True)
    forest = _Forest(len(named))
    for x, y in where.reshape(-1, 2).tolist():
        forest.join(x, y)
    return named[np.array(forest.edges, np.int64).reshape(-1, 2)]


BITS = 1 << 29  # bits of a unit's rows at once


def linked(
    sets: list[np.ndarray], share: tuple[int, int], forest: _Forest, first: list[int], second: list[int] | None = None
) -> None:
    """Join in `forest` the places whose sets reach the share: every two of
    `first`, or each of `first` with each of `second`."""
    both = first + (second or [])
    order = sorted(both, key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    owner = np.repeat(np.arange(len(order)), sizes)
    _, which, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = df > 1
    width = max(1, -(-int(shared.sum()) // 64))
    if len(order) > 2 and width * 64 * len(order) > BITS:  # fewer sets share fewer shingles
        if second is None:
            half = len(order) // 2
            linked(sets, share, forest, order[:half])
            linked(sets, share, forest, order[half:])
            linked(sets, share, forest, order[:half], order[half:])
        else:
            more, less = (first, second) if len(first) >= len(second) else (second, first)
            linked(sets, share, forest, more[: len(more) // 2], less)
            linked(sets, share, forest, more[len(more) // 2 :], less)
        return
    number = np.cumsum(shared) - 1
    inside = shared[which]
    bit = number[which[inside]]
    rows = np.zeros((len(order), width), np.uint64)
    np.bitwise_or.at(rows, (owner[inside], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    low, high = share
    members = set(first)
    side = np.array([i in members for i in order])
    root = np.array([forest.root(i) for i in order])
    for i in range(len(order)):
        # Sorted by size: later sets are as large, and at most size * high / low.
        stop = np.searchsorted(sizes, sizes[i] * high // low, side="right")
        rest = np.arange(i + 1, stop)
        rest = rest[root[rest] != root[i]]
        if second is not None:
            rest = rest[side[rest] != side[i]]
        for start in range(0, len(rest), 4096):
            some = rest[start : start + 4096]
            common = np.bitwise_count(rows[some] & rows[i]).sum(axis=1, dtype=np.int64)
            hit = some[high * common >= low * (sizes[some] + sizes[i] - common)]
            for j in hit.tolist():
                if root[j] != root[i]:
                    forest.join(order[i], order[j])
                    root[root == root[j]] = root[i]


# --- Spark ------------------------------------------------------------------


def _made(width: int, collections: int, depth: int):
    def made(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), byte_texts(batch.column("text"))
            for a, b in slices(texts, 2 << 20):
                sets = [shingle_set(t, width) for t in texts[a:b]]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, bands([sets[i] for i in full], collections, depth)):
                        keys[i] = row.tobytes()
                data = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(d) if d else None for d in data], pa.binary()),
                        pa.array(keys, pa.binary()),
                        pa.array(data, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands", "shingles"],
                )

    return made


def _spread(collections: int, buckets: int):
    """Nodes to bucket blocks of (key, node). Nodes of a batch that share a key
    are joined here: their forest goes out as pairs under a key of its own, and
    of each key one row."""

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            data = batch.column("bands").to_pylist()
            for start in range(0, len(nodes), 4096):
                some = nodes[start : start + 4096]
                rows = np.frombuffer(b"".join(data[start : start + 4096]), np.uint64).reshape(-1, collections)
                key = tensored(rows)
                owner = np.repeat(some, key.shape[1])
                key = key.ravel()
                edges, first = sharing(key, owner)
                own = (edges[:, 0] * 31 + edges[:, 1]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                key = np.concatenate([key[first], own, own])
                owner = np.concatenate([owner[first], edges[:, 0], edges[:, 1]])
                block = (key >> np.uint64(32)) % np.uint64(buckets * SUBS)
                order = np.argsort(block, kind="stable")
                found, begins = np.unique(block[order].astype(np.int32), return_index=True)
                stops = np.append(begins[1:], len(order))
                key, owner = key[order], owner[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found // SUBS),
                        pa.array(found % SUBS),
                        pa.array([key[a:b].tobytes() for a, b in zip(begins, stops)], pa.binary()),
                        pa.array([owner[a:b].tobytes() for a, b in zip(begins, stops)], pa.binary()),
                    ],
                    names=["bucket", "sub", "keys", "nodes"],
                )

    return blocks


def _meet(table: pa.Table) -> pa.Table:
    table = table.select(["sub", "keys", "nodes"])
    found = []
    for sub in range(SUBS):
        part = table.filter(pc.equal(table.column("sub"), sub))
        keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.uint64)
        nodes = np.frombuffer(b"".join(part.column("nodes").to_pylist()), np.int64)
        found.append(sharing(keys, nodes)[0])
    edges = forest_of(np.concatenate(found))
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


def _verify(share: tuple[int, int]):
    def verified(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("p", "ascending"), ("q", "ascending")])
        n = table.num_rows
        names = [table.column(c).to_numpy() for c in ("cluster", "p", "q")]
        p, q, part = names[1], names[2], table.column("part").to_numpy()
        fresh = np.append(True, np.any([x[1:] != x[:-1] for x in names], axis=0))
        starts = np.flatnonzero(fresh)
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        forest = _Forest(n)
        for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist()):
            here = np.arange(a, b)
            if p[a] == q[a]:
                linked(sets, share, forest, here.tolist())
            else:  # each part compares its own rows in a unit of its own
                linked(sets, share, forest, here[part[a:b] == p[a]].tolist(), here[part[a:b] == q[a]].tolist())
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        ids, nodes = table.column("id").to_numpy(), table.column("node").to_numpy()
        a, b = edges[:, 0], edges[:, 1]
        return pa.table({"a_id": ids[a], "a_node": nodes[a], "b_id": ids[b], "b_node": nodes[b]})

    return verified


def _by_key(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with side, which has one row for each key and says in weight
    how much of `total` the key's rows are. Keys above a thousandth, of which
    there are at most a thousand, are broadcast; the others are shuffled."""
    hot = F.col(weight) > total / HOT_KEYS
    heavy = F.broadcast(side.filter(hot))
    light = rows.join(F.broadcast(side.filter(hot).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(light.join(side.filter(~hot), key))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    share: tuple[int, int] = SHARE,
    collections: int = COLLECTIONS,
    depth: int = DEPTH,
    bucket_bytes: int = BUCKET_BYTES,
    unit_bytes: int = UNIT_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (whether
    it is the row's own id) of every row."""
    spark = docs.sparkSession
    store = StageStore(spark)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = plain.mapInArrow(_made(width, collections, depth), _ROW)
    # A row's number is fixed by writing it.
    rows = store.put("sets", made.withColumn("uid", F.monotonically_increasing_id()))
    own = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), F.col("uid").alias("node"))
    first = F.min(F.struct(own.alias("lead"), "bands")).alias("m")
    nodes = rows.filter("n_shingles > 0").groupBy("digest").agg(first, F.count("*").alias("rows"))
    nodes = store.put(
        "nodes", nodes.select("digest", "rows", F.col("m.lead.node").alias("node"), "m.lead", "m.bands")
    )

    # Clusters: who shares a key, over all tables.
    tables = collections * (collections - 1) // 2
    buckets = pieces(nodes.count() * tables * 16, bucket_bytes, 12)
    keyed = nodes.select("node", "bands").mapInArrow(_spread(collections, buckets), _BLOCK)
    met = keyed.groupBy("bucket").applyInArrow(_meet, "a long, b long")
    clusters = store.put("clusters", components(met, "met").toDF("node", "cluster"))

    # Their sets, in units of bounded size.
    short = clusters.count() <= broadcast_rows
    side = clusters.withColumnRenamed("node", "uid")
    sets = rows.select(F.col("uid"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), "shingles")
    sets = sets.join(F.broadcast(side) if short else side, "uid").withColumnRenamed("uid", "node")
    sets = store.put("clustered", sets)
    size = F.sum(F.octet_length("shingles") + 16)
    spans = store.put("spans", sets.groupBy("cluster").agg(size.alias("size")))
    total = spans.agg(F.sum("size")).first()[0] or 0
    parted = spans.withColumn("parts", F.ceil(2 * F.col("size") / unit_bytes).cast("int"))
    parted = parted.withColumn("parts", F.when(F.col("size") <= unit_bytes, 1).otherwise(F.col("parts")))
    dealt = _by_key(sets, parted, "cluster", "size", total)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", other)
    # Every two parts meet once; a part alone is compared in itself, so the
    # units (p, q) with p < q skip pairs of one part.
    units = dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    # A cluster of n parts moves n times.
    moved = parted.agg(F.sum(F.col("size") * F.col("parts"))).first()[0] or 0
    tasks = pieces(moved, TASK_BYTES, 12)
    units = units.withColumn("task", F.pmod(F.xxhash64("cluster", "p", "q"), F.lit(tasks)).cast("int"))
    units = units.select("task", "cluster", "p", "q", "part", "node", "id", "shingles")
    links = units.groupBy("task").applyInArrow(
        _verify(share), "a_id long, a_node long, b_id long, b_node long"
    )

    def end(name: str) -> F.Column:
        return F.struct(F.col(f"{name}_id").alias("id"), F.col(f"{name}_node").alias("node")).alias(name)

    grouped = components(links.select(end("a"), end("b"))).select(
        F.col("node.node").alias("node"), F.col("component.id").alias("component")
    )
    owner = nodes.join(grouped, "node", "left").select(
        "digest", "rows", F.coalesce("component", "lead.id").alias("component")
    )
    owner = store.put("owner", owner)
    some = rows.select("doc_id", "n_shingles", "digest")
    full = _by_key(some.filter("n_shingles > 0"), owner, "digest", "rows", some.count())
    found = full.select("doc_id", "n_shingles", F.nullif("component", F.lit(int(NO_ID))).alias("component_id"))
    alone = some.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

