"""Terms of many rows counted at once, as Arrow arrays, in the task that reads them.

What leaves a task is short: a row for each term of a run of rows, or a row of
two arrays for each report. A run holds some TERMS_AT_ONCE terms (one row at
least), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import WORD_CLASS

TERMS_AT_ONCE = 200_000
#: Bytes of text that stand for a word when texts are dealt into runs.
WORD_BYTES = 6
#: Class sums that a task holds before it sends them on.
SUMS_AT_ONCE = 4_000_000
#: Cells of the Count-Min row that bars rare n-grams, and of a block on its way.
CELL_BITS = 22
BLOCK_CELLS = 1 << 14


def list_sizes(column: pa.ListArray) -> np.ndarray:
    """Elements of each list; NULL has none."""
    return np.array(pc.fill_null(column.value_lengths(), 0), np.int64)


def runs(column: pa.ListArray | pa.StringArray, at_once: int) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of rows that hold some at_once elements (texts:
    as many words, by their bytes)."""
    if pa.types.is_list(column.type):
        ends = np.cumsum(list_sizes(column))
    else:
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(column), 0), np.int64)) // WORD_BYTES
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        yield a, b - a
        a = b


def one_by_one(batches) -> Iterator[pa.RecordBatch]:
    """The batches, none of them held any longer while the next is read."""
    batches = iter(batches)
    while (batch := next(batches, None)) is not None:
        yield batch
        del batch


@cache
def word_characters() -> np.ndarray:
    """Whether a code point belongs to a word, as Spark itself reads WORD_CLASS
    (libraries know letters of different Unicode versions), in packed bits.
    Spark is asked once a process."""
    every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    asked = SparkSession.active().createDataFrame([(every,)], "s string")
    found = asked.select(F.regexp_replace("s", f"[^{WORD_CLASS}]+", "")).first()[0]
    held = np.zeros(0x110000, bool)
    held[[ord(c) for c in found]] = True
    return np.packbits(held)


def coded_words(
    column: pa.ListArray | pa.StringArray, characters: np.ndarray
) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each row, the number of each word, the distinct words) of lists
    of words, where a NULL has number -1, or of lower-case texts, which are cut
    here (characters: word_characters(), unpacked): a text moves as one value,
    not as one for each word."""
    if pa.types.is_list(column.type):
        coded = column.flatten().dictionary_encode()
        return list_sizes(column), np.array(pc.fill_null(coded.indices, -1), np.int64), coded.dictionary
    sizes, words = _cut(pc.fill_null(column, ""), characters)
    coded = words.dictionary_encode()
    return sizes, np.array(coded.indices, np.int64), coded.dictionary


def _cut(texts: pa.StringArray, characters: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """(words of each text, the words): runs of two or more word characters."""
    rows = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or rows[0] == rows[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[rows[0] : rows[-1]]
    rows = rows - rows[0]
    begins = (data & 0xC0) != 0x80  # the first byte of a character
    if begins.all():
        inside, length = characters[data], None
    else:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        length = np.append(0, np.cumsum(begins))
        inside = characters[points][length[1:] - 1]
    # A word starts after what is no word character, or with its text.
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    start = np.flatnonzero(inside & np.append(True, ~inside[:-1] | cut[1:-1]))
    end = np.flatnonzero(inside & np.append(~inside[1:] | cut[1:-1], True)) + 1
    long = (end - start if length is None else length[end] - length[start]) >= 2
    start, end = start[long], end[long]
    turns = np.zeros(len(data) + 1, np.int8)
    turns[start] += 1
    turns[end] -= 1
    kept = data[np.cumsum(turns[:-1], dtype=np.int8).view(bool)]
    ends = np.append(0, np.cumsum(end - start)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(kept))
    return np.diff(np.searchsorted(start, rows)), words


def lookup(terms: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms as numbers: their words, the term each word is (-1: none), and
    the bigrams as sorted pairs of word numbers with their terms."""
    cut = [t.partition(" ") for t in terms]
    words = sorted({w for first, space, second in cut for w in ((first, second) if space else (first,))})
    place = {w: k for k, w in enumerate(words)}
    single, pairs = np.full(len(words) + 1, -1), [(-1, -1)]
    for i, (first, space, second) in enumerate(cut):
        if space:
            pairs.append((place[first] * len(words) + place[second], i))
        else:
            single[place[first]] = i
    keys, ids = np.array(sorted(pairs), np.int64).T
    return pa.array(words, pa.string()), single, keys, ids


def known_terms(
    coded: tuple[np.ndarray, np.ndarray, pa.Array], terms: tuple, stop_words: pa.Array, ngram_max: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(term, first token, last token) of the occurrences of known terms (a
    lookup()), in token positions over all rows of coded_words(): words, then
    bigrams. Each distinct word is looked up once, a bigram by its words' numbers."""
    words, single, keys, pair_ids = terms
    sizes, codes, met = coded
    kept = np.flatnonzero(~np.array(pc.is_in(met, value_set=stop_words), bool)[codes])
    number = np.array(pc.fill_null(pc.index_in(met, value_set=words), -1), np.int64)[codes[kept]]
    ids = single[number]
    yield ids[ids >= 0], kept[ids >= 0], kept[ids >= 0]
    if ngram_max == 2 and len(number) > 1:
        owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
        met = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (owner[:-1] == owner[1:]))
        pair = number[met] * len(words) + number[met + 1]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        own = keys[at] == pair
        yield pair_ids[at[own]], kept[met[own]], kept[met[own] + 1]


def pair_counts(owner: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, occurrences) of the distinct pairs, by owner and code."""
    pairs, times = np.unique(owner * max(1, n) + codes, return_counts=True)
    return pairs // max(1, n), pairs % max(1, n), times


def _counted(batches) -> Iterator[pa.RecordBatch]:
    for batch in one_by_one(batches):
        column = batch.column("terms")
        for a, length in runs(column, TERMS_AT_ONCE):
            part = column.slice(a, length)
            coded = part.flatten().dictionary_encode()
            codes = np.array(pc.fill_null(coded.indices, -1), np.int64)
            owner = np.repeat(np.arange(length), list_sizes(part))[codes >= 0]
            yield _statistics(coded.dictionary, owner, codes[codes >= 0])
        del batch, column


_STATISTICS = "term string, tf long, df long"


def partial_statistics(documents: DataFrame) -> DataFrame:
    """term, tf, df of runs of documents: to be added up by term."""
    return documents.select("terms").mapInArrow(_counted, _STATISTICS)


def _kept_words(column: pa.Array, dropped: pa.Array, characters: np.ndarray) -> tuple:
    """(document and number of each word but stop words and NULLs, the distinct words)."""
    sizes, codes, words = coded_words(column, characters)
    stop = np.append(np.array(pc.is_in(words, value_set=dropped), bool), True)  # last: NULL
    kept = np.flatnonzero(~stop[codes])
    return np.repeat(np.arange(len(column)), sizes)[kept], codes[kept], words


def _cells(words: pa.Array, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count-Min cell of each word of a run, and of the bigrams that `inside` marks."""
    hashes = pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False)[codes]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[inside]
    pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return tuple((h >> np.uint64(64 - CELL_BITS)).astype(np.int64) for h in (hashes, pairs))


def ngram_cells(documents: DataFrame, stop_words: Sequence[str], ngram_max: int) -> np.ndarray:
    """A Count-Min row of all n-grams: the occurrences of those that share a cell,
    2 ** CELL_BITS numbers, whatever the size of the corpus. Tasks send theirs in
    blocks, which are added up by block; the sums come to the driver (16 MB)."""
    stops, bits = list(stop_words), word_characters()
    source = "lowered" if "lowered" in documents.columns else "tokens"

    def counted(batches) -> Iterator[pa.RecordBatch]:
        dropped, characters = pa.array(stops, pa.string()), np.unpackbits(bits).view(bool)
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in one_by_one(batches):
            column = batch.column(source)
            for a, length in runs(column, TERMS_AT_ONCE):
                owner, codes, words = _kept_words(column.slice(a, length), dropped, characters)
                if len(codes):
                    single, pairs = _cells(words, codes, owner[:-1] == owner[1:])
                    np.add.at(cells, single, np.uint32(1))
                    if ngram_max == 2:
                        np.add.at(cells, pairs, np.uint32(1))
            del batch, column
        yield from _blocks({i: c for i, c in enumerate(cells.reshape(-1, BLOCK_CELLS)) if c.any()})

    def added(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in one_by_one(batches):
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells")):
                more = sums.get(block, 0) + np.frombuffer(cells.as_buffer(), np.uint32).astype(np.int64)
                sums[block] = np.minimum(more, 0xFFFFFFFF)
            del batch
        yield from _blocks({i: c.astype(np.uint32) for i, c in sums.items()})

    shape = "block int, cells binary"
    parts = documents.select(source).mapInArrow(counted, shape)
    total = np.zeros(1 << CELL_BITS, np.uint32).reshape(-1, BLOCK_CELLS)
    for row in parts.repartition("block").mapInArrow(added, shape).collect():
        total[row.block] = np.frombuffer(row.cells, np.uint32)
    return total.ravel()


def _blocks(cells: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(list(cells), pa.int32()), pa.array([c.tobytes() for c in cells.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["block", "cells"])


def partial_ngrams(
    documents: DataFrame, stop_words: Sequence[str], ngram_max: int, free: np.ndarray | None = None
) -> DataFrame:
    """The same from documents' tokens or lower-case texts (`lowered`): stop words
    go first, bigrams are formed after, as pairs of word numbers; only distinct
    ones become texts. free: which cells of ngram_cells() count; n-grams of other
    cells are dropped before they are counted."""
    stops, bits = list(stop_words), word_characters()
    source = "lowered" if "lowered" in documents.columns else "tokens"
    sent = None if free is None else documents.sparkSession.sparkContext.broadcast(np.packbits(free))

    def counted(batches) -> Iterator[pa.RecordBatch]:
        dropped, characters = pa.array(stops, pa.string()), np.unpackbits(bits).view(bool)
        passes = None if sent is None else np.unpackbits(sent.value).view(bool)
        for batch in one_by_one(batches):
            column = batch.column(source)
            for a, length in runs(column, TERMS_AT_ONCE):
                owner, codes, words = _kept_words(column.slice(a, length), dropped, characters)
                if not len(codes):
                    continue
                inside = owner[:-1] == owner[1:]
                first, second, of = codes[:-1][inside], codes[1:][inside], owner[:-1][inside]
                if passes is not None:
                    single, pair = (passes[cells] for cells in _cells(words, codes, inside))
                    owner, codes = owner[single], codes[single]
                    first, second, of = first[pair], second[pair], of[pair]
                yield _statistics(words, owner, codes)
                if ngram_max == 2 and len(first):
                    pairs, place = np.unique(first * len(words) + second, return_inverse=True)
                    first, second = (words.take(pa.array(half)) for half in divmod(pairs, len(words)))
                    yield _statistics(pc.binary_join_element_wise(first, second, " "), of, place)
            del batch, column

    return documents.select(source).mapInArrow(counted, _STATISTICS)


def _statistics(terms: pa.Array, owner: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """term, tf, df of occurrences, given by document and place in terms."""
    tf = np.bincount(codes, minlength=len(terms))
    _, met, _ = pair_counts(owner, codes, len(terms))
    found = np.flatnonzero(tf)
    df = np.bincount(met, minlength=len(terms))
    return pa.RecordBatch.from_arrays(
        [terms.take(pa.array(found)), pa.array(tf[found]), pa.array(df[found])], names=["term", "tf", "df"]
    )


def known_counts(documents: DataFrame, terms: list[str], scale: np.ndarray | None = None) -> DataFrame:
    """report_id, idx, x: the places in `terms` that occur in a document's
    terms, in ascending order, and how often; a row for each document. With
    scale (a factor for each term), x is the scaled counts' unit vector. The
    list is sent to every task."""
    kind = documents.schema["report_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast((terms, scale))

    def counted(batches) -> Iterator[pa.RecordBatch]:
        terms, scale = sent.value
        known = pa.array(terms, pa.string())
        for batch in one_by_one(batches):
            column = batch.column("terms")
            for a, length in runs(column, TERMS_AT_ONCE):
                part = column.slice(a, length)
                coded = part.flatten().dictionary_encode()
                # Each distinct term is looked up once; a NULL is no term.
                place = np.array(pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1), np.int64)
                codes = np.array(pc.fill_null(coded.indices, -1), np.int64)
                ids = np.append(place, -1)[codes]
                owner = np.repeat(np.arange(length), list_sizes(part))[ids >= 0]
                owner, idx, x = pair_counts(owner, ids[ids >= 0], len(known))
                if scale is not None:
                    x = x * scale[idx]
                    norm = np.sqrt(np.bincount(owner, weights=x * x, minlength=length))[owner]
                    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                ends = pa.array(np.searchsorted(owner, np.arange(length + 1)), pa.int32())
                listed = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (idx.astype(np.int32), x)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("report_id").slice(a, length), *listed], names=["report_id", "idx", "x"]
                )
            del batch, column

    number = "long" if scale is None else "double"
    return documents.select("report_id", "terms").mapInArrow(
        counted, f"report_id {kind}, idx array<int>, x array<{number}>"
    )


def _label_sums(batches) -> Iterator[pa.RecordBatch]:
    for batch in one_by_one(batches):
        for a, length in runs(batch.column("values"), TERMS_AT_ONCE):
            part = batch.slice(a, length)
            sizes = list_sizes(part.column("values"))
            label = part.column("label").dictionary_encode(null_encoding="encode")
            names, codes = label.dictionary, np.array(label.indices, np.int64)
            # A dense vector has no indices: there the place is the index.
            idx = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            indices = part.column("indices")
            idx[np.repeat(np.array(indices.is_valid(), bool), sizes)] = np.array(indices.flatten(), np.int64)
            width = int(idx.max(initial=0)) + 1
            pairs, place = np.unique(np.repeat(codes, sizes) * width + idx, return_inverse=True)
            sums = np.bincount(place, weights=np.array(part.column("values").flatten(), float), minlength=len(pairs))
            rows = np.bincount(codes, minlength=len(names))
            columns = [
                names.take(pa.array(np.append(pairs // width, np.arange(len(names))))),
                pa.concat_arrays([pa.array(pairs % width, pa.int32()), pa.nulls(len(names), pa.int32())]),
                pa.concat_arrays([pa.array(sums, pa.float64()), pa.nulls(len(names), pa.float64())]),
                pa.array(np.append(np.zeros(len(pairs), np.int64), rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "idx", "s", "n"])
            del part, indices
        del batch


def label_sums(vectors: DataFrame, vector: str = "tfidf") -> DataFrame:
    """label, idx, s, n of runs of vectors, to be added up by label and idx: the
    entries' sum, and with NULL idx the number of vectors."""
    raw = vectors.select("label", F.unwrap_udt(vector).alias("v")).select("label", "v.indices", "v.values")
    kind = vectors.schema["label"].dataType.simpleString()
    return raw.mapInArrow(_label_sums, f"label {kind}, idx int, s double, n long")


def text_label_sums(
    documents: DataFrame, terms: list[str], scale: np.ndarray, stop_words: Sequence[str], ngram_max: int
) -> DataFrame:
    """What label_sums() gives for the unit vectors of the scaled term counts of
    documents (label, lowered), which are counted and added up where they are
    read. A task sends a row for each label and term it met, and holds some
    SUMS_AT_ONCE sums (one label's at least)."""
    kind = documents.schema["label"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast((lookup(terms), scale))
    stops, bits = list(stop_words), word_characters()

    def summed(batches) -> Iterator[pa.RecordBatch]:
        held, scale = sent.value
        dropped = pa.array(stops, pa.string())
        characters = np.unpackbits(bits).view(bool)
        most, sums, rows = max(1, SUMS_AT_ONCE // max(1, len(scale))), {}, {}
        for batch in one_by_one(batches):
            for a, length in runs(batch.column("lowered"), TERMS_AT_ONCE):
                part = batch.slice(a, length)
                coded = coded_words(part.column("lowered"), characters)
                ends = np.cumsum(coded[0])
                ids, first = zip(*(found[:2] for found in known_terms(coded, held, dropped, ngram_max)))
                owner = np.searchsorted(ends, np.concatenate(first), side="right")
                owner, idx, x = pair_counts(owner, np.concatenate(ids), len(scale))
                x = x * scale[idx]
                norm = np.sqrt(np.bincount(owner, weights=x * x, minlength=length))[owner]
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                label = part.column("label").dictionary_encode(null_encoding="encode")
                of = np.array(label.indices, np.int64)
                for code, name in enumerate(label.dictionary.to_pylist()):
                    if name not in sums and len(sums) >= most:
                        yield from (_sums_batch(part.schema.field("label").type, k, sums[k], rows[k]) for k in sums)
                        sums, rows = {}, {}
                    own = of[owner] == code
                    more = np.bincount(idx[own], weights=x[own], minlength=len(scale))
                    sums[name] = sums.get(name, 0.0) + more
                    rows[name] = rows.get(name, 0) + int((of == code).sum())
                del part, coded, label
            kept = batch.schema.field("label").type
            del batch
        if sums:
            yield from (_sums_batch(kept, k, sums[k], rows[k]) for k in sums)

    return documents.select("label", "lowered").mapInArrow(summed, f"label {kind}, idx int, s double, n long")


def _sums_batch(kind: pa.DataType, label, sums: np.ndarray, rows: int) -> pa.RecordBatch:
    """A label's sums without zeros, and with NULL idx its number of rows."""
    idx = np.flatnonzero(sums)
    columns = [
        pa.array([label] * (len(idx) + 1), kind),
        pa.array([*idx.tolist(), None], pa.int32()),
        pa.array([*sums[idx].tolist(), None], pa.float64()),
        pa.array(np.append(np.zeros(len(idx), np.int64), rows)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["label", "idx", "s", "n"])
