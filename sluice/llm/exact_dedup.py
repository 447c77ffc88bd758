"""Exact dedup: heavy digests by broadcast, the others by a shuffle.

Texts are equal when identical after lower-casing A-Z only. The SHA-256 of the
normalised text stands for it from then on, so no text is shuffled. A
Misra-Gries summary over all digests names those that may be frequent; a second
pass counts these exactly and takes the row that stays. They are decided on the
map side from a broadcast table of at most `heavy` rows. The remaining digests,
each of fewer than rows / heavy copies, go through an ordinary shuffle.

Defined cases: null counts as the empty text. Of equal texts the row with the
largest id stays; a null id is smaller than every other. Among rows that repeat
both id and text one row stays. An empty table gives an empty result. Other
columns are not read, and kept_documents() returns them unchanged.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sluice.llm.common import byte_texts, free_name, stage
from sluice.llm.sketches import frequent

HEAVY = 1024


@F.arrow_udf(T.BinaryType())
def digest_of(texts: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased."""
    return pa.array([hashlib.sha256(t.lower()).digest() for t in byte_texts(texts)], pa.binary())


def decisions(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each input row."""
    spark = docs.sparkSession
    rows = stage(
        spark,
        "digests",
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text).alias("digest"))
        # A row's own number, fixed by writing it: settles ties of id and text.
        .withColumn("row", F.monotonically_increasing_id()),
    )
    suspects = list(frequent(rows, "digest", heavy, lambda column: column.to_pylist()))
    named = F.broadcast(
        spark.createDataFrame([(bytes(d),) for d in suspects], "digest binary")
    )
    best = F.max(F.struct("doc_id", "row")).alias("best")
    winners = (
        rows.join(named, "digest", "left_semi")
        .groupBy("digest")
        .agg(best, F.count("*").alias("group_size"))
        .collect()
    )
    shape = "digest binary, best struct<doc_id: long, row: long>, group_size long"
    verified = F.broadcast(spark.createDataFrame(winners, shape))
    frequent_rows = rows.join(verified, "digest")
    same = W.partitionBy("digest")
    rare_rows = rows.join(named, "digest", "left_anti").select(
        "digest",
        "doc_id",
        "row",
        F.max(F.struct("doc_id", "row")).over(same).alias("best"),
        F.count("*").over(same).alias("group_size"),
    )
    return frequent_rows.unionByName(rare_rows).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    made = stage(docs.sparkSession, "exact_decisions", decisions(docs, doc_id, text))
    return kept_rows(docs, made, doc_id, text)


def kept_rows(docs: DataFrame, made: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents by the decisions made (doc_id, digest, kept) of their rows;
    of rows that repeat both id and text one stays."""
    # (id, digest) of rows that go. Rows repeating both share the pair with the
    # one that stays, so they are told apart from the others and reduced last.
    key = [F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")]
    pairs = made.groupBy(*key).agg(F.count("*").alias("_n"), F.max("kept").alias("_kept"))
    gone = pairs.filter(~F.col("_kept"))
    tied = pairs.filter(F.col("_kept") & (F.col("_n") > 1))
    digest = free_name("_text_digest", docs.columns)
    marked = docs.withColumn(digest, digest_of(text))

    def same(side):
        return docs[doc_id].eqNullSafe(side["_id"]) & (marked[digest] == side["_digest"])

    left = marked.join(gone, same(gone), "left_anti")
    if tied.isEmpty():
        return left.drop(digest)
    single = left.join(tied, same(tied), "left_anti")
    once = left.join(tied, same(tied), "left_semi").dropDuplicates([doc_id, digest])
    return single.unionByName(once).drop(digest)
