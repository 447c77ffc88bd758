"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (number of distinct five-word shingles). In a
partition of at most `upper` shingles, the MinHash sketch of an item holds its
floor((1 - t) * upper) + 1 smallest shingle hashes, all of them if it has fewer.
A document that contains a share of t or more of an item lacks at most
floor((1 - t) * size) of its shingles, so it holds at least one of the sketch:
the search loses nothing. Documents probe the sketches with every shingle of
their whole text; candidates are verified by exact containment of shingle
strings. No row of the documents is shuffled.

Items are taken in blocks of at most `block` rows and BLOCK_BYTES of text (one
item at least). The driver reads a block, sends it and forgets it; with more than
one, what a block finds is written before the next is read, so neither driver nor
tasks ever hold two. Each further block is another pass over the documents.

Defined cases: text is compared with A-Z lower-cased, as words
[^\\x20\\x09-\\x0D]+. A text of fewer than five words has one shingle, the whole
sequence; a text without words, or null, contains nothing and is contained in
nothing. Rows that repeat an id are judged row by row, and an item that occurs
twice is found twice. An empty table on either side gives an empty result;
without items every document is clean. contained_items() reads no other columns,
clean_documents() returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import WordHashes, byte_texts, rolling_hashes, slices, stage

WIDTH, SHARE, BLOCK = 5, 0.8, 20_000
BLOCK_BYTES = 32 << 20
_WORDS = WordHashes()
_RESULT = "doc_id long, item_id long, matched long, item_shingles long, containment double"


def _shingles(words: list[bytes], width: int) -> set[bytes]:
    if not words:
        return set()
    if len(words) < width:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    return rolling_hashes(_WORDS.of(words), min(width, len(words))) if words else np.empty(0, np.uint64)


class _Sketches:
    """Sketch hash -> items, of one block, with the items' own shingles."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]], width: int, share: float) -> None:
        self.shingles: list[tuple[int, set[bytes]]] = []
        found: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = (text or "").encode().lower().split()
            own = _shingles(words, width)
            if not own:
                continue
            hashes = np.unique(_hashes(words, width))
            upper = 1 << (len(own) - 1).bit_length()  # partitions: sizes up to 1, 2, 4, 8, ...
            keep = int((1 - share) * upper + 1e-9) + 1
            for h in hashes[:keep].tolist():
                found[h].append(len(self.shingles))
            self.shingles.append((item_id, own))
        self.items = dict(found)
        self.table = np.zeros(1 << self.BITS, bool)
        keys = np.fromiter(found, np.uint64, len(found))
        self.table[keys >> np.uint64(64 - self.BITS)] = True

    def candidates(self, hashes: np.ndarray) -> set[int]:
        near = hashes[self.table[hashes >> np.uint64(64 - self.BITS)]]
        return {i for h in near.tolist() for i in self.items.get(h, ())}


def _blocks(items: DataFrame, item_id: str, text: str, block: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Bounded runs of items, each with whether it is the last; one empty run
    if there are no items."""
    held, size = [], 0
    rows = items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator()
    for row in rows:
        if held and (len(held) == block or size + len(row[1] or "") > BLOCK_BYTES):
            yield held, False
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1] or "")
    yield held, True


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    share: float = SHARE,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, item_id, matched, item_shingles, containment: every pair in
    which the document holds at least `share` of the item's shingles."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def search(sent) -> DataFrame:
        def probe(batches):
            sketches = _Sketches(sent.value, width, share)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                texts = byte_texts(batch.column("text"))
                for a, b in slices(texts, 4 << 20):
                    out = list(_matches(zip(ids[a:b], texts[a:b]), sketches, width, share))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[k] for r in out], kind)
                            for k, kind in enumerate([pa.int64()] * 4 + [pa.float64()])
                        ],
                        names=["doc_id", "item_id", "matched", "item_shingles", "containment"],
                    )

        return docs.mapInArrow(probe, _RESULT)

    found = []
    for held, last in _blocks(items, item_id, item_text, block):
        sent = spark.sparkContext.broadcast(held)
        found.append(search(sent))
        if not last:
            found[-1] = stage(spark, "contained", found[-1])
            sent.destroy()
    return reduce(DataFrame.unionAll, found)


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    share: float = SHARE,
    block: int = BLOCK,
) -> DataFrame:
    """The documents that hold no item, with all their columns. A row is judged
    where it is read, by its own text: nothing is joined or moved, and null or
    repeated ids don't matter."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index(text)

    def sift(sent) -> DataFrame:
        def clean(batches):
            sketches = _Sketches(sent.value, width, share)
            for batch in batches:
                texts = byte_texts(batch.column(at))
                gone = {k for k, *_ in _matches(enumerate(texts), sketches, width, share)}
                yield batch.filter(pa.array([k not in gone for k in range(len(texts))], pa.bool_()))

        return docs.mapInArrow(clean, schema)

    for held, last in _blocks(items, item_id, item_text, block):
        sent = spark.sparkContext.broadcast(held)
        docs = sift(sent)
        if not last:
            docs = stage(spark, "clean", docs)
            sent.destroy()
    return docs


def _matches(docs, sketches: _Sketches, width: int, share: float):
    for doc_id, text in docs:
        words = text.lower().split()
        candidates = sketches.candidates(_hashes(words, width))
        if not candidates:
            continue
        own = _shingles(words, width)
        for i in sorted(candidates):
            item_id, wanted = sketches.shingles[i]
            matched = len(wanted & own)
            if matched >= share * len(wanted) - 1e-9:
                yield doc_id, item_id, matched, len(wanted), matched / len(wanted)
