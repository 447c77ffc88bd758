"""Token counts by a two-tier lookup of pre-token lengths.

A pre-token is a space or line feed with what follows it up to the next one. No
piece of the model holds either of them elsewhere than at its start (checked
when the model is opened), so the count of a text is the sum over its
pre-tokens; a literal U+2581 is cut as the space that the model takes it for.
First tier: the most frequent pre-tokens of all documents, found by Misra-Gries summaries, with their lengths in a broadcast table of at most
`frequent_size` short entries. Second tier: a bounded cache in each worker;
only what misses both is encoded, in batches. No pre-token is shuffled.

Defined cases: null text is the empty text, of no tokens. Rows that repeat an id
are counted row by row. An empty table gives an empty result. Very long texts
are taken in one piece, one text at a time. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import byte_texts, slices
from sluice.llm.sketches import frequent
from sluice.llm.tokens import missing

FREQUENT, LONGEST, CACHED, LIMIT = 32_768, 64, 400_000, 4096
_PRE_TOKENS = re.compile(rb"[ \n] *[^ \n]*")
_SPACE = "▁".encode()  # the model takes it and the space for one symbol


@lru_cache(maxsize=1)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    space = "▁"
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if space in piece.lstrip(space) or "\n" in piece or " " in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token")
    return model


def pre_tokens(text: bytes) -> list[bytes]:
    """Of the text behind the space that the model puts before it."""
    return _PRE_TOKENS.findall(b" " + text.replace(_SPACE, b" ")) if text else []


def lengths(model, chunks: list[bytes]) -> list[int]:
    """Tokens of each pre-token. The model's own leading space stands for the
    one that a pre-token begins with; before a line feed it is one token more."""
    bare = [c[1:] if c[:1] == b" " else c for c in chunks]
    ids = model.encode([b.decode("utf-8", "replace") for b in bare], num_threads=1)
    return [
        (len(i) or 1) if c[:1] == b" " else len(i) - 1 for c, i in zip(chunks, ids)
    ]


def _keys(column) -> list[bytes]:
    return [c for t in byte_texts(column) for c in pre_tokens(t) if len(c) <= LONGEST]


class _Lookup:
    def __init__(self, path: str, table: dict[bytes, int], cached: int) -> None:
        self.path, self.table, self.cached = path, table, cached
        self.known = dict(table)

    def counts(self, texts: list[bytes]) -> list[int]:
        chunked = [pre_tokens(t) for t in texts]
        found = [list(map(self.known.get, chunks)) for chunks in chunked]
        # Places without a length, which are few, are filled in afterwards.
        gaps = [(c, known, missing(known)) for c, known in zip(chunked, found) if None in known]
        unknown = list({c[k] for c, _, places in gaps for k in places})
        if len(self.known) + len(unknown) > self.cached:
            self.known = dict(self.table)
        fresh = dict(zip(unknown, lengths(_model(self.path), unknown)))
        self.known.update(fresh)
        for c, known, places in gaps:
            for k in places:
                known[k] = fresh[c[k]]
        return list(map(sum, found))


_LOOKUPS: dict[str, _Lookup] = {}


def _lookup(key: str, path: str, table, cached: int) -> _Lookup:
    """The lookup of this run, one for each worker; earlier runs' are dropped."""
    if key not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[key] = _Lookup(path, table.value, cached)
    return _LOOKUPS[key]


def token_counts(
    docs: DataFrame,
    model_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    frequent_size: int = FREQUENT,
    cached: int = CACHED,
    limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common = [c for c, _ in frequent(docs, "text", frequent_size, _keys).most_common(frequent_size)]
    table = docs.sparkSession.sparkContext.broadcast(
        dict(zip(common, lengths(_model(model_path), common)))
    )

    key = uuid.uuid4().hex

    def count(batches):
        lookup = _lookup(key, model_path, table, cached)
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            counts = [n for a, b in slices(texts, 4 << 20) for n in lookup.counts(texts[a:b])]
            counts = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(counts),
                    pa.array(counts > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
