"""Group-disjoint splits, seeded subsets and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.ranking import cutoff, first_by_hash, hash_order, rank_within
from sluice.session import StageStore


def _share_of_groups(share: float):
    # The reference rounds the test side up.
    return F.ceil(F.lit(share) * F.col("n_keys")).cast("long")


def group_split(
    df: DataFrame,
    group: str = "group_id",
    test_share: float = 0.2,
    seed: int = 42,
    validation_share: float = 0.0,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Adds split = test / validation / train, the shares counted in groups.
    Where the groups lie is decided once, as one or two cut-off hashes; each
    row then compares its own hash with them, so no row moves and a group may
    be of any size. Groups are NULL only in unlabelled data: they train.
    groups: the groups of df as a stored table. Then df isn't computed once more
    for each edge, and the edges are found at once, not again by every reader."""
    h = hash_order(F.col(group), seed)
    keys = (df if groups is None else groups).filter(F.col(group).isNotNull()).select(group)

    def edge(wanted: Column) -> Column:
        found = cutoff(keys, group, seed, wanted)
        return found.scalar() if groups is None else F.lit(found.first().h)

    branch = F.when(h <= edge(_share_of_groups(test_share)), "test")
    if validation_share:
        both = _share_of_groups(test_share) + _share_of_groups(validation_share)
        branch = branch.when(h <= edge(both), "validation")
    return df.withColumn("split", branch.otherwise("train"))


def leaked_groups(split: DataFrame, group: str = "group_id") -> DataFrame:
    """One row: the number of groups on more than one side (must be 0)."""
    sides = split.groupBy(group).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return sides.agg(F.count_if(F.col("lo") != F.col("hi")).alias("leaked_groups"))


def split_report(split: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows, groups and classes per side, from one pre-aggregated pass."""
    cells = split.groupBy("split", group, "label").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("split").agg(
        F.sum("n").alias("n_rows"),
        F.countDistinct(group).alias("n_groups"),
        F.countDistinct("label").alias("n_classes"),
    )


def subset(df: DataFrame, n: int, key: str = "report_id", seed: int = 42) -> DataFrame:
    """A fixed n-key subset without replacement."""
    return first_by_hash(df, key, seed, n)


def select_reports(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose report id was chosen."""
    return df.join(chosen.select("report_id"), "report_id", "left_semi")


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "label", key: str = "report_id", seed: int = 42
) -> DataFrame:
    """Adds fold = 0 .. k-1, each label dealt out evenly in hash order."""
    ranked = rank_within(df, label, key, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def group_folds(df: DataFrame, k: int = 5, group: str = "group_id", seed: int = 42) -> DataFrame:
    """Adds fold so that no group is in two folds; no shuffle needed."""
    digits = F.substring(hash_order(F.col(group), seed), 1, 8)
    return df.withColumn("fold", (F.conv(digits, 16, 10).cast("long") % k).cast("int"))


# Groups above this share of a fold are placed one by one: at most
# k / HEAVY_SHARE of them. The others share SLOTS hash slots.
HEAVY_SHARE = 0.01
SLOTS = 1_024


def stratified_group_folds(
    df: DataFrame,
    store: StageStore,
    k: int = 5,
    group: str = "group_id",
    label: str = "label",
    seed: int = 42,
    max_labels: int = 1_000,
) -> DataFrame:
    """Adds fold = 0 .. k-1: no group is in two folds, and every fold has nearly
    its share of every label. Rows are counted by (group, label) once. Units, that
    is heavy groups and hash slots of the others, are placed from the largest to
    the smallest where the squares of the label shares grow least; their label
    counts, (k / HEAVY_SHARE + SLOTS) x labels at most, are all that reaches the
    driver. A label's rows in a fold differ from a k-th of them by no more than
    about the largest unit's. Rows without a group are one group."""
    cells = store.put("group_labels", df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")))
    rows = cells.agg(F.sum("n")).first()[0] or 0
    labels = cells.select(label).distinct().limit(max_labels + 1).count()
    if labels > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    sizes = cells.groupBy(group).agg(F.sum("n").alias("size"))
    heavy = F.broadcast(sizes.filter(F.col("size") > rows * HEAVY_SHARE / k).select(F.col(group).alias("_heavy")))
    digits = F.substring(hash_order(F.coalesce(F.col(group).cast("string"), F.lit("")), seed), 1, 8)
    slot = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(SLOTS))
    marked = cells.join(heavy, F.col(group).eqNullSafe(F.col("_heavy")) & F.col(group).isNotNull(), "left")
    unit = F.when(F.col("_heavy").isNull(), F.lit(None)).otherwise(F.col(group))
    units = marked.groupBy(
        unit.alias("heavy"), F.when(F.col("_heavy").isNull(), slot.cast("int")).alias("slot"), label
    ).agg(F.sum("n").alias("n"))
    placed = _placed([(r.heavy, r.slot, r[label], r.n) for r in units.collect()], k)
    slots = [placed.get((None, s), s % k) for s in range(SLOTS)]
    by_slot = F.get(F.array(*[F.lit(f) for f in slots]), slot.cast("int"))
    spark = df.sparkSession
    named = [(g, f) for (g, s), f in placed.items() if s is None]
    kind = df.schema[group].dataType.simpleString()
    fixed = F.broadcast(spark.createDataFrame(named, f"_heavy {kind}, _fold int"))
    found = df.join(fixed, F.col(group) == F.col("_heavy"), "left")
    return found.withColumn("fold", F.coalesce("_fold", by_slot)).drop("_heavy", "_fold")


def _placed(cells: list[tuple], k: int) -> dict[tuple, int]:
    """(heavy group or None, slot or None) -> fold, from label counts."""
    counts: dict[tuple, dict] = {}
    total: dict = {}
    for heavy, slot, label, n in cells:
        counts.setdefault((heavy, slot), {})[label] = n
        total[label] = total.get(label, 0) + n
    held: list[dict] = [{} for _ in range(k)]
    placed = {}
    for unit, own in sorted(counts.items(), key=lambda x: (-sum(x[1].values()), str(x[0]))):

        def cost(fold: int) -> float:  # growth of the sum of squared label shares
            return sum((2 * held[fold].get(c, 0) + n) * n / total[c] ** 2 for c, n in own.items())

        fold = min(range(k), key=lambda f: (cost(f), sum(held[f].values()), f))
        placed[unit] = fold
        for c, n in own.items():
            held[fold][c] = held[fold].get(c, 0) + n
    return placed
