"""Token ids as files of fixed-width bits.

Each id takes as many bits as the largest id of the vocabulary needs. A file is
a Parquet part whose rows are blocks: some 65,536 ids of whole documents, the
documents' ids and offsets, and the packed bits. 64 ids of w bits fill exactly w
64-bit words, so id k of a block lies in the words from k * w // 64 on: any id
or range is read without unpacking what precedes it, and whole blocks unpack
with w-independent numpy steps. Blocks of other documents are skipped by the
Parquet statistics of first_id and last_id.

Documents are range-partitioned and sorted by id, so files follow each other in
id order. Each block knows its place in the file; the places of the files are
sums over one row a file.

Defined cases: null text is the empty text; each document gets the end id, the
empty one only that. Null ids sort first. Rows that repeat an id follow each
other in the order of their texts. An empty table gives no file and an empty
result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import byte_texts, slices
from sluice.llm.tokens import text_encoder

BLOCK = 65_536
_BLOCKS = (
    "file int, block int, first_id long, last_id long, first_token long, n_tokens long, "
    "bits int, doc_ids array<long>, offsets array<long>, payload binary"
)


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids of `bits` bits each (1 to 32), in groups of 64 ids to `bits` words."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 64)
    words = np.zeros((groups, bits), "<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= padded[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= padded[:, k] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """ids start to stop of a block, from the words that hold them alone."""
    if stop <= start:
        return np.empty(0, np.uint32)
    first, last = start // 64, -(-stop // 64)
    words = np.frombuffer(payload, "<u8", (last - first) * bits, first * bits * 8)
    words = words.reshape(last - first, bits)
    ids = np.empty((last - first, 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        ids[:, k] = value & mask
    return ids.reshape(-1)[start - first * 64 : stop - first * 64]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    vocabulary: int,
    end_id: int,
    spaced: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> None:
    """Encode every document and write the files below path, in id order."""
    bits = id_bits(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sorted_docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches):
        encoder = text_encoder(tokenizer, spaced)
        file = TaskContext.get().partitionId()
        number, place = 0, 0
        ids: list[int | None] = []
        encoded: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal number, place, ids, encoded, held
            sizes = np.array([len(e) // 4 for e in encoded], np.int64)
            offsets = np.append(0, np.cumsum(sizes))
            known = [i for i in ids if i is not None]
            values = np.frombuffer(b"".join(encoded), "<u4")
            out = [
                [file], [number], [min(known, default=None)], [max(known, default=None)],
                [place], [len(values)], [bits], [ids], [offsets], [pack(values, bits)],
            ]
            kinds = [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.int32()] + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            number, place = number + 1, place + len(values)
            ids, encoded, held = [], [], 0
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

        for batch in batches:
            batch_ids = batch.column("doc_id").to_pylist()
            texts = byte_texts(batch.column("text"))
            for a, b in slices(texts, 4 << 20):
                for i, e in zip(batch_ids[a:b], encoder.encode(texts[a:b])):
                    ids.append(i)
                    encoded.append(e + end)
                    held += len(e) // 4 + 1
                    if held >= block:
                        yield row()
        if ids:
            yield row()

    sorted_docs.mapInArrow(blocks, _BLOCKS).write.option("compression", "zstd").parquet(path)


def file_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Tokens before each file; one row a file comes to the driver."""
    sums = spark.read.parquet(path).groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    starts, before = {}, 0
    for file, n in sorted((r.file, r.n) for r in sums):
        starts[file], before = before, before + n
    return starts


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    starts = file_starts(spark, path)

    def documents(batches):
        for batch in batches:
            for b in batch.to_pylist():
                offsets = np.array(b["offsets"], np.int64)
                raw = unpack(b["payload"], b["bits"], 0, b["n_tokens"]).astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["doc_ids"], pa.int64()),
                        pa.array(starts[b["file"]] + b["first_token"] + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    read = spark.read.parquet(path)
    return read.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document (one array for each row of it)."""
    rows = spark.read.parquet(path).filter(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")))
    return [
        unpack(b.payload, b.bits, b.offsets[k], b.offsets[k + 1])
        for b in rows.orderBy("file", "block").toLocalIterator()
        for k, i in enumerate(b.doc_ids)
        if i == doc_id
    ]
