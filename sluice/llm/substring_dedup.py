"""Substring dedup: repeated word windows, merged into maximal intervals.

Documents are dealt into parts by hash. A part computes the Rabin-Karp hash of
every window of `width` words and sends each distinct hash once, with the
smallest document id that holds it in the part, in sorted blocks to hash
buckets. A bucket finds the smallest id over all parts and answers with one bit
for each hash: a smaller document holds it. The part reads its texts again,
merges the covered words into maximal intervals and removes them.

A window that a third of all rows share costs one entry a part. Texts are
shuffled once (both readings use the same exchange), hashes once, answers are
bits. Memory is that of one part or one bucket, whose sizes are parameters.

Defined cases: a null text has no words. A text of fewer words than `width` is
kept whole. A null id counts as larger than every id. Rows that share an id are
judged as one document: none of them removes words of another, and each repeats
in the result as often as in the input. An empty table gives an empty result.
Columns other than the two named are not read. Windows are compared by a 64-bit
hash (of 10^8 windows two differ under one hash with probability below 0.001).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import (
    WordHashes,
    back_to_ids,
    byte_texts,
    int_ids,
    pieces,
    rolling_hashes,
    text_bytes,
)

PART_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
_WORDS = WordHashes()

_BLOCKS = "part int, bucket int, n int, hashes binary, ids binary"
_ANSWERS = "part int, bucket int, n int, bits binary"
_RESULT = (
    "doc_id long, n_words long, n_removed long, kept string, "
    "intervals array<struct<start: int, stop: int>>"
)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: sorted or small numbers then compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view(kind)


class _Part:
    """The documents of a part in ascending id order, and their windows."""

    def __init__(self, table: pa.Table, width: int) -> None:
        ids = int_ids(table.column("doc_id"))
        order = np.argsort(ids, kind="stable")
        texts = byte_texts(table.column("text"))
        self.ids = ids[order]
        self.words = [texts[i].split() for i in order]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.n = int(self.counts.sum())
        flat = [_WORDS.of(w) for w in self.words]
        hashes = rolling_hashes(np.concatenate(flat), width) if flat else np.empty(0, np.uint64)
        ends = np.cumsum(self.counts)
        inside = np.zeros(self.n, bool)
        for stop, count in zip(ends, self.counts):
            if count >= width:
                inside[stop - count : stop - width + 1] = True
        self.places = np.flatnonzero(inside)
        self.owners = np.repeat(self.ids, self.counts)[self.places]
        self.distinct, first, self.which = np.unique(
            hashes[self.places], return_index=True, return_inverse=True
        )
        self.smallest = self.owners[first]


def _edges(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in sorted hashes, and where each begins."""
    return np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_index=True)


def removed_windows(
    docs: DataFrame,
    width: int = 13,
    doc_id: str = "doc_id",
    text: str = "text",
    part_bytes: int = PART_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space), intervals
    (maximal runs of removed words, stop exclusive)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = text_bytes(docs, "text")
    parts = pieces(total, part_bytes, 12)
    bits = max(1, (pieces(total, bucket_bytes) - 1).bit_length())
    placed = docs.withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    )

    def blocks(table: pa.Table) -> pa.Table:
        part = _Part(table, width)
        buckets, starts = _edges(part.distinct, bits)
        stops = np.append(starts[1:], len(part.distinct))
        return pa.table(
            {
                "part": pa.array(np.full(len(buckets), table.column("part")[0].as_py()), pa.int32()),
                "bucket": pa.array(buckets, pa.int32()),
                "n": pa.array(stops - starts, pa.int32()),
                "hashes": pa.array([_planes(part.distinct[a:b]) for a, b in zip(starts, stops)], pa.binary()),
                "ids": pa.array([_planes(part.smallest[a:b]) for a, b in zip(starts, stops)], pa.binary()),
            }
        )

    def answers(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        hashes = np.concatenate(
            [_numbers(b, n, np.uint64) for b, n in zip(table.column("hashes").to_pylist(), sizes)]
        )
        ids = np.concatenate(
            [_numbers(b, n, np.int64) for b, n in zip(table.column("ids").to_pylist(), sizes)]
        )
        order = np.argsort(hashes)
        ranked = hashes[order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        least = np.minimum.reduceat(ids[order], starts)
        smaller = np.empty(len(ids), bool)
        smaller[order] = np.repeat(least, np.diff(np.append(starts, len(ids)))) < ids[order]
        stops = np.cumsum(sizes)
        return pa.table(
            {
                "part": table.column("part"),
                "bucket": table.column("bucket"),
                "n": table.column("n"),
                "bits": pa.array(
                    [np.packbits(smaller[b - n : b]).tobytes() for b, n in zip(stops, sizes)], pa.binary()
                ),
            }
        )

    def cut(table: pa.Table, answered: pa.Table) -> pa.Table:
        part = _Part(table, width)
        answered = answered.sort_by("bucket")
        flags = [
            np.unpackbits(np.frombuffer(b, np.uint8), count=n)
            for b, n in zip(answered.column("bits").to_pylist(), answered.column("n").to_pylist())
        ]
        elsewhere = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        gone = elsewhere[part.which] | (part.owners > part.smallest[part.which])
        covered = _cover(part, gone, width)
        return _result(part, covered)

    grouped = placed.groupBy("part")
    blocked = grouped.applyInArrow(blocks, _BLOCKS)
    answered = blocked.groupBy("bucket").applyInArrow(answers, _ANSWERS)
    return grouped.cogroup(answered.groupBy("part")).applyInArrow(cut, _RESULT)


def _cover(part: _Part, gone: np.ndarray, width: int) -> np.ndarray:
    """Words that a removed window covers."""
    change = np.zeros(part.n + width + 1, np.int32)
    change[part.places[gone]] += 1
    change[part.places[gone] + width] -= 1
    return np.cumsum(change)[: part.n] > 0


def _result(part: _Part, covered: np.ndarray) -> pa.Table:
    stops = np.cumsum(part.counts)
    starts = stops - part.counts
    kept, removed = [], []
    for words, a, b in zip(part.words, starts, stops):
        here = covered[a:b]
        removed.append(int(here.sum()))
        kept.append(b" ".join(compress(words, ~here) if removed[-1] else words))
    # An interval ends where the next word is kept or belongs to another document.
    heads = covered.copy()
    heads[1:] &= ~covered[:-1]
    tails = covered.copy()
    tails[:-1] &= ~covered[1:]
    inner = starts[(starts > 0) & (starts < part.n)]
    heads[inner] |= covered[inner]
    tails[inner - 1] |= covered[inner - 1]
    begin, end = np.flatnonzero(heads), np.flatnonzero(tails) + 1
    owner = np.searchsorted(stops, begin, side="right")
    offsets = np.searchsorted(begin, np.append(starts, part.n))
    spans = pa.StructArray.from_arrays(
        [
            pa.array(begin - starts[owner], pa.int32()),
            pa.array(end - starts[owner], pa.int32()),
        ],
        names=["start", "stop"],
    )
    return pa.table(
        {
            "doc_id": back_to_ids(part.ids),
            "n_words": pa.array(part.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "intervals": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
        }
    )
