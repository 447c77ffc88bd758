"""Best-fit packing of documents into sequences under three capacities.

A document's ids and an end id are cut into pieces of at most `tokens` ids (the
first one may be shorter). A sequence has residual tokens, document count and
attention cost (sum of squared lengths). Pieces go in by descending length, each
into the open sequence that can take it under every constraint and whose
weighted residual norm is smallest afterwards; else a sequence is opened.

Pieces of one length are alike, and so are sequences of one residual. The plan
is therefore made for the histogram of lengths (at most `tokens` rows) with
multiplicities: it says which ranks of a length go to which run of sequences,
and equals what piece-by-piece best fit does. Its size depends on the number of
lengths, not of documents, so it is made on the driver and broadcast. Pieces are
ranked inside their length in Spark, in hash parts, as one length may hold most
of the rows. Ids never leave the task that encoded them; only their checksum
travels.

Defined cases: a null text is empty and has only its end id. Rows that repeat an
id are packed row by row. An empty table gives an empty result. Other columns
are not read. The capacities must admit a piece of `tokens` ids alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import byte_texts, numbered, rank_parts, slices, stage
from sluice.llm.tokens import text_encoder

TOKENS = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacities:
    """Of one sequence. Document count and cost don't bind by default, so that
    as few sequences as possible are used; they still rank the sequences."""

    tokens: int = TOKENS
    documents: int = TOKENS
    cost: int = TOKENS * TOKENS
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    tokens: int = TOKENS,
    spaced: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = text_encoder(tokenizer, spaced)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = byte_texts(batch.column("text"))
            for a, b in slices(texts, 4 << 20):
                rows: list[tuple] = []
                for doc, encoded in zip(ids[a:b], encoder.encode(texts[a:b])):
                    encoded += end
                    n = len(encoded) // 4
                    stop = n % tokens or tokens
                    start, piece = 0, 0
                    while start < n:
                        part = encoded[4 * start : 4 * stop]
                        rows.append((doc, piece, start, stop - start, zlib.crc32(part)))
                        start, stop, piece = stop, stop + tokens, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(cut, _PIECES)


def plan(histogram: Iterable[tuple[int, int]], capacity: Capacities = Capacities()) -> np.ndarray:
    """Rows (length, first rank, sequences, pieces in each, first sequence,
    offset): piece number rank of a length lies in sequence
    first + (rank - first rank) % sequences, behind the pieces of the same row
    that come before it there."""
    rows: list[tuple[int, ...]] = []
    limits = np.array([capacity.tokens, capacity.documents, capacity.cost], float)
    weights = np.array(capacity.weights)
    # Open sequences in runs of equal residual: residual tokens, documents, cost; first, count.
    state = np.empty((0, 3))
    runs: list[tuple[int, int]] = []
    opened = 0
    for length, count in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], float)
        rank = 0
        while rank < count:
            fits = np.flatnonzero((state >= demand).all(axis=1))
            if len(fits):
                left = (state[fits] - demand) / limits
                best = int(fits[np.argmin((weights * left * left).sum(axis=1))])
                residual, (first, many) = state[best], runs[best]
                state = np.delete(state, best, axis=0)
                del runs[best]
            else:
                residual, first, many = limits, opened, count
            each = int((residual // demand).min())
            if not each:
                raise ValueError(f"a piece of {length} ids exceeds the capacities")
            wanted = count - rank
            full = min(many, wanted // each)
            steps = [(full, each)] if full else []
            if full < many and wanted - full * each:
                steps.append((1, wanted - full * each))
            used = 0
            for sequences, inside in steps:
                rows.append((length, rank, sequences, inside, first + used, int(limits[0] - residual[0])))
                state = np.vstack([state, residual - inside * demand])
                runs.append((first + used, sequences))
                rank += sequences * inside
                used += sequences
            if len(fits):
                if used < many:
                    state = np.vstack([state, residual])
                    runs.append((first + used, many - used))
            else:
                opened += used
        alive = state[:, 0] > 0
        runs = [r for r, a in zip(runs, alive) if a]
        state = state[alive]
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(pieces_of: DataFrame, capacity: Capacities = Capacities()) -> DataFrame:
    """The pieces (a stage table) with sequence_id and offset."""
    spark = pieces_of.sparkSession
    histogram = [tuple(r) for r in pieces_of.groupBy("length").count().collect()]
    rows = plan(histogram, capacity)
    total = sum(n for _, n in histogram)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    sent = spark.sparkContext.broadcast(rows)
    splits = rank_parts(total)
    ranked = numbered(
        pieces_of, "length", F.xxhash64("doc_id", "piece", "ids_crc32"), splits, "rank", spark
    )

    def place(batches):
        table = sent.value
        lengths = table[:, 0]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            # Rows of a length lie together, by first rank; take the last that begins in time.
            low = np.searchsorted(lengths, length, side="left")
            high = np.searchsorted(lengths, length, side="right")
            while (low + 1 < high).any():
                middle = (low + high) // 2
                later = (middle < high) & (table[np.minimum(middle, len(table) - 1), 1] <= rank)
                low, high = np.where(later, middle, low), np.where(later, high, np.maximum(middle, low + 1))
            row = table[low]
            inside = rank - row[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [
                    pa.array(row[:, 4] + inside % row[:, 2]),
                    pa.array(row[:, 5] + inside // row[:, 2] * length),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")


def packed_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: Capacities = Capacities(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    cut = cut_pieces(docs, tokenizer, end_id, capacity.tokens, True, doc_id, text)
    return pack(stage(docs.sparkSession, "pieces", cut), capacity)
