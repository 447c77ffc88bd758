"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard scores a key by weight / -ln(u), u a hash of key and shard in (0, 1);
the highest score takes the record. A further shard changes nothing between the
others, so it takes records only into itself, about its share of the weight.
Everything is a column expression over one row; only short rows are shuffled, to
number the records of a shard. They are numbered in parts by the row's own number,
as a shard may be large and any number of its records equal.

Defined cases: records of a null key all go to one shard. Records that repeat a
key, or are equal in every column, go to the same shard, each to a slot of its
own. An empty table gives an empty result. Weights must be positive. Columns of
any type may come along, maps too; a column named like one of the result
(shard, slot, grown_shard) is returned under that name with an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import free_name, numbered, rank_parts, stage

_RESOLUTION = 1 << 53


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Ties of scores go to the lower shard."""
    h = F.xxhash64(key, shard).bitwiseAND(F.lit(_RESOLUTION - 1))
    u = (h + F.lit(0.5)) / F.lit(float(_RESOLUTION))
    return F.struct((-weight / F.log(u)).alias("score"), (-shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 to len(weights) - 1 of a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = F.transform(
        F.array(*[F.lit(float(w)) for w in weights]),
        lambda weight, shard: _score(key, shard, weight),
    )
    return -F.array_max(scores)["shard"]


def _kept_names(columns: Sequence[str], made: Sequence[str]) -> list[str]:
    """The names that the records' columns have beside those of `made`."""
    lower = {m.lower() for m in made}
    return [free_name(c, [*made, *columns]) if c.lower() in lower else c for c in columns]


def sharded(records: DataFrame, key: str, weights: Sequence[float]) -> DataFrame:
    """All columns of the records with shard, slot (gapless from 0 in a shard)
    and grown_shard (the shard if one more of mean weight is added). Give it
    the short columns of a record; write_shards() moves whole records."""
    spark, name = records.sparkSession, F.col(key).cast("string")
    mean = sum(weights) / len(weights)
    # The record travels as one column, so no name of it meets a name used here.
    # Written once: a row's number, which parts equal records, stays as it is.
    placed = stage(
        spark,
        "placed",
        records.select(
            shard_of(name, weights).alias("shard"),
            shard_of(name, [*weights, mean]).alias("grown_shard"),
            F.struct(*[records[c] for c in records.columns]).alias("record"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )
    splits = rank_parts(placed.count())
    done = numbered(placed, "shard", F.xxhash64("row"), splits, "slot", spark, order=["row"])
    made = ["shard", "slot", "grown_shard"]
    kept = zip(records.columns, _kept_names(records.columns, made), strict=True)
    return done.select(*[F.col("record").getField(c).alias(out) for c, out in kept], *made)


def write_shards(records: DataFrame, key: str, weights: Sequence[float], path: str, files: int = 1) -> None:
    """Whole records as Parquet, one folder for each shard, `files` files in it."""
    name = F.col(key).cast("string")
    kept = zip(records.columns, _kept_names(records.columns, ["shard"]), strict=True)
    file = free_name("file", [*records.columns, "shard"])
    (
        records.select(
            *[records[c].alias(out) for c, out in kept],
            shard_of(name, weights).alias("shard"),
            F.pmod(F.xxhash64(name), F.lit(files)).alias(file),
        )
        .repartition(len(weights) * files, "shard", file)
        .drop(file)
        .write.partitionBy("shard")
        .parquet(path)
    )
