"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprint: 64 bits from XXH64 (seed 42) of the word shingles. Two documents
are linked when their fingerprints differ in at most two bits; a group is a
connected component of these links.

Search. The fingerprint is cut into segments a (23 bits), b (23) and c (18). The
perfect binary Golay code (23, 12, 7) decodes a segment word, and the words one
bit away from it, to the indices of the nearest codewords: one index if the word
lies within two bits of a codeword, six if it lies three away. Words at most one
bit apart share an index. Two errors over three segments leave one of these
cases, each with a key of 30 or 35 bits:
  c without error, so a or b has at most one:   (c, index of a), (c, index of b)
  c with an error, so a or b has none, the other at most one:
                                                (a, index of b), (b, index of a)
Fingerprints that share a key are verified by their Hamming distance.

Equal fingerprints are one node, so copies cost nothing. Keys are dealt into
buckets by hash; a bucket sends only the edges of a spanning forest of the links
inside it, never all pairs. Under one key, small groups compare shifted arrays;
large ones link fingerprints through shared one-bit neighbours (distance two or
less if and only if one is shared or one is the other's neighbour), which is
linear in the group. Components are then joined in Spark, with stage tables.

Defined cases: a null or empty text has fingerprint zero, linked like any other;
a text of fewer words than `width` has one shingle. Null ids are larger than any
other id and come back as null. Rows are linked by their fingerprints only, never
by an id they share, be it repeated or null. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import NO_ID, byte_texts, pieces, stage
from sluice.llm.exact_dedup import kept_rows

SEED, WIDTH, DISTANCE = 42, 3, 2
KEYS_IN_BUCKET = 200_000
STRIDE = 50_000
GOLAY_POLYNOMIAL = 0b110001110101  # fixed value: generator of the (23, 12, 7) code


# --- fingerprints -----------------------------------------------------------


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(s, SEED) for s in shingles], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """A bit is set if it is set in over half of the shingle hashes."""
    words = text.lower().split()
    counts, n = np.zeros(64, np.int64), 0
    for start in range(0, max(1, len(words) - width + 1), STRIDE):  # long texts piece by piece
        hashes = _shingle_hashes(words[start : start + STRIDE + width - 1], width)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH
) -> DataFrame:
    """doc_id, fp, digest: the fingerprint as a signed long, and the SHA-256 of
    the text with A-Z lower-cased."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def made(batches):
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            values = [fingerprint(t, width) for t in texts]
            digests = [hashlib.sha256(t.lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array(values, np.uint64).view(np.int64)),
                    pa.array(digests, pa.binary()),
                ],
                names=["doc_id", "fp", "digest"],
            )

    return docs.mapInArrow(made, "doc_id long, fp long, digest binary")


# --- keys -------------------------------------------------------------------


@lru_cache(maxsize=1)
def nearest_codeword() -> np.ndarray:
    """Index of the nearest codeword for each of the 2**23 words."""
    messages = np.arange(1 << 12, dtype=np.uint32)
    codewords = np.zeros(1 << 12, np.uint32)
    for bit in range(12):  # message polynomial times generator polynomial
        codewords ^= np.where(messages >> bit & 1, np.uint32(GOLAY_POLYNOMIAL << bit), np.uint32(0))
    ball = [0]
    ones = [1 << k for k in range(23)]
    for i in range(23):
        ball.append(ones[i])
        for j in range(i):
            ball.append(ones[i] | ones[j])
            ball.extend(ones[i] | ones[j] | ones[k] for k in range(j))
    table = np.empty(1 << 23, np.uint16)
    for error in ball:
        table[codewords ^ np.uint32(error)] = messages
    return table


def nearby_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word the distinct codeword indices of the word and of
    its one-bit neighbours: row numbers and indices, one pair for each."""
    table = nearest_codeword()
    flips = np.append(np.uint32(0), np.uint32(1) << np.arange(23, dtype=np.uint32))
    found = np.sort(table[segment[:, None].astype(np.uint32) ^ flips], axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, places = np.nonzero(fresh)
    return rows, found[rows, places].astype(np.uint64)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys of fingerprints (unsigned)."""
    u = np.uint64
    a, b, c = fps & u((1 << 23) - 1), fps >> u(23) & u((1 << 23) - 1), fps >> u(46)
    rows_a, near_a = nearby_indices(a)
    rows_b, near_b = nearby_indices(b)
    parts = [
        (rows_a, c[rows_a], near_a),
        (rows_b, c[rows_b], near_b),
        (rows_b, a[rows_b], near_b),
        (rows_a, b[rows_a], near_a),
    ]
    return (
        np.concatenate([rows for rows, _, _ in parts]),
        np.concatenate(
            [u(kind) << u(60) | exact << u(12) | near for kind, (_, exact, near) in enumerate(parts)]
        ),
    )


# --- links inside a bucket --------------------------------------------------


class _Forest:
    """Union-find over positions; keeps the edges that joined two trees."""

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


def _large_group(fps: np.ndarray, places: np.ndarray, forest: _Forest) -> None:
    one = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
    variants = (fps[:, None] ^ one).ravel()
    owners = np.repeat(places, 65)
    order = np.argsort(variants, kind="stable")
    same = np.flatnonzero(variants[order][1:] == variants[order][:-1])
    for x, y in zip(owners[order][same].tolist(), owners[order][same + 1].tolist()):
        forest.join(x, y)


def links(
    fps: np.ndarray, key: np.ndarray, where: np.ndarray, n: int, small: int = 64
) -> list[tuple[int, int]]:
    """Edges of a spanning forest, over nodes 0 to n - 1, of the pairs that
    share a key and differ in at most two bits; where: the node of each row."""
    order = np.argsort(key, kind="stable")
    ranked, values = key[order], fps[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(starts, len(ranked)))
    group = np.repeat(sizes, sizes)
    nodes = where[order]
    forest = _Forest(n)
    for shift in range(1, min(small, int(sizes.max(initial=1)))):
        left = np.flatnonzero((ranked[shift:] == ranked[:-shift]) & (group[:-shift] <= small))
        near = np.bitwise_count(values[left] ^ values[left + shift]) <= DISTANCE
        for x, y in zip(nodes[left[near]].tolist(), nodes[left[near] + shift].tolist()):
            forest.join(x, y)
    for k in np.flatnonzero(sizes > small).tolist():
        part = slice(starts[k], starts[k] + sizes[k])
        _large_group(values[part], nodes[part], forest)
    return forest.edges


# --- components -------------------------------------------------------------


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """node, component (smallest node reachable) for every node of the edges
    (a, b). Large-star and small-star steps by turns: each joins edges to the
    smallest neighbour of a node, which is pre-aggregated before the shuffle;
    every round is a stage table."""
    spark = edges.sparkSession
    now = stage(spark, f"{name}_0", edges.filter("a <> b").distinct())
    for step in range(1, 200):
        # Large star: every larger neighbour is tied to the smallest neighbour.
        both = now.unionAll(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(low.toDF("a", "b")).filter("a <> b").distinct()
        after = stage(spark, f"{name}_{step}", small)
        # A star forest: every node hangs on one root, and no root hangs on another.
        rising = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        roots = after.select(F.col("b").alias("a")).distinct()
        if rising.isEmpty() and after.join(roots, "a", "left_semi").isEmpty():
            pairs = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
            own = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return pairs.unionAll(own)
        now = after
    raise RuntimeError("components did not settle")


def decisions(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH
) -> DataFrame:
    """doc_id, fp, digest, component_id (smallest id reachable), kept for every
    row. A node is a fingerprint, ranked by the smallest id of its rows. Kept is
    the row of the smallest (id, digest) of the smallest fingerprint reachable."""
    spark = docs.sparkSession
    made = fingerprints(docs, doc_id, text, width)
    rows = stage(spark, "fingerprints", made.withColumn("id", F.coalesce("doc_id", F.lit(int(NO_ID)))))
    first = F.min(F.struct("id", "digest")).alias("first")
    nodes = stage(spark, "nodes", rows.groupBy("fp").agg(first).select("fp", "first"))
    count = nodes.count()
    buckets = pieces(count * 22, KEYS_IN_BUCKET, 12)

    def spread(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            ids = batch.column("id").to_numpy()
            for start in range(0, len(fps), 20_000):
                part = fps[start : start + 20_000]
                which, key = keys(part)
                mixed = key * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(part[which].view(np.int64)),
                        pa.array(ids[start : start + 20_000][which]),
                    ],
                    names=["bucket", "key", "fp", "id"],
                )

    def linked(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().view(np.uint64)
        fps = table.column("fp").to_numpy()
        distinct, places, where = np.unique(fps, return_index=True, return_inverse=True)
        ids = table.column("id").to_numpy()[places]
        edges = np.array(links(fps.view(np.uint64), key, where, len(distinct)), np.int64).reshape(-1, 2)
        a, b = edges[:, 0], edges[:, 1]
        return pa.table({"a_id": ids[a], "a_fp": distinct[a], "b_id": ids[b], "b_fp": distinct[b]})

    def node(side: str) -> F.Column:
        return F.struct(F.col(f"{side}_id").alias("id"), F.col(f"{side}_fp").alias("fp")).alias(side)

    keyed = nodes.select("fp", "first.id").mapInArrow(spread, "bucket int, key long, fp long, id long")
    edges = keyed.groupBy("bucket").applyInArrow(linked, "a_id long, a_fp long, b_id long, b_fp long")
    grouped = components(edges.select(node("a"), node("b"))).select(
        F.col("node.fp").alias("fp"), F.col("component").alias("lead")
    )
    own = F.struct(F.col("first.id").alias("id"), F.col("fp"))
    owner = nodes.join(grouped, "fp", "left").select("fp", "first", F.coalesce("lead", own).alias("lead"))
    return rows.join(owner, "fp").select(
        "doc_id",
        "fp",
        "digest",
        F.nullif("lead.id", F.lit(int(NO_ID))).alias("component_id"),
        ((F.col("fp") == F.col("lead.fp")) & (F.struct("id", "digest") == F.col("first"))).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH
) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable) for every row."""
    return decisions(docs, doc_id, text, width).select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of each group, with all columns."""
    made = stage(docs.sparkSession, "near_decisions", decisions(docs, doc_id, text))
    return kept_rows(docs, made, doc_id, text)
