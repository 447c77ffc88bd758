"""The vocabulary of a corpus whose distinct n-grams are far too many to shuffle.

Most n-grams are rare. A Count-Min table of fixed size bars those that can't be
in the vocabulary before anything is shuffled by term; the survivors are counted
exactly, so the vocabulary is the one that counting everything gives.

  1. A bounded number of reports names candidates: frequent terms in them.
  2. One pass counts two things in one grouping with map-side sums: the cells of
     the Count-Min table (`depth` hash rows of `width` cells, occurrences and
     reports) and, exactly, the candidates. A task sends at most depth * width +
     candidates short rows, whatever the number of its n-grams.
  3. The max_features-th largest count of a candidate with enough reports bounds
     that of the vocabulary's last term from below (0 if there are fewer
     candidates). A term is barred if in any hash row its cell has fewer
     occurrences than the bound, or fewer reports than min_df: cells never count
     too little, so no term of the vocabulary is barred.
  4. A second pass drops barred terms where they are read, by a bitmap of
     depth * width bits, and counts the others.

Which reports name candidates changes only how many terms survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.vocabulary import counted_terms, term_occurrences, vocabulary
from sluice.params import CascadeParams
from sluice.session import StageStore

WIDTH, DEPTH = 1 << 20, 2
NAMING_REPORTS = 2_000


def _cell(row: int, width: int) -> Column:
    return F.pmod(F.xxhash64("term", F.lit(row)), F.lit(width)).cast("int")


def candidate_terms(documents: DataFrame, max_features: int | None, reports: int = NAMING_REPORTS) -> DataFrame:
    """term, id: at most 1.25 * max_features terms, the most frequent of a
    bounded number of reports."""
    found = counted_terms(term_occurrences(documents.limit(reports)))
    most = found.orderBy(F.desc("tf"), "term").limit(0 if max_features is None else max_features * 5 // 4)
    return most.select("term", F.monotonically_increasing_id().alias("id"))


def term_sketch(
    documents: DataFrame, candidates: DataFrame, width: int = WIDTH, depth: int = DEPTH
) -> DataFrame:
    """row, cell, tf, df: the Count-Min cells (row < depth) and the candidates'
    exact counts (row = depth, cell = id)."""
    named = term_occurrences(documents).join(F.broadcast(candidates), "term", "left")
    cells = [F.struct(F.lit(r).alias("row"), _cell(r, width).cast("long").alias("cell")) for r in range(depth)]
    own = F.struct(F.lit(depth).alias("row"), F.col("id").alias("cell"))
    rows = named.select("is_new", F.explode_outer(F.array(*cells, own)).alias("x"))
    return (
        rows.filter(F.col("x.cell").isNotNull())
        .groupBy(F.col("x.row").alias("row"), F.col("x.cell").alias("cell"))
        .agg(F.count(F.lit(1)).alias("tf"), F.count_if("is_new").alias("df"))
    )


def lower_bound(sketch: DataFrame, max_features: int | None, min_df: int, depth: int = DEPTH) -> int:
    """Occurrences that the last term of the vocabulary has at least."""
    if max_features is None or max_features <= 0:
        return 0
    exact = sketch.filter((F.col("row") == depth) & (F.col("df") >= min_df))
    top = exact.orderBy(F.desc("tf")).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf"))
    found = top.first()
    return found.tf if found.n == max_features else 0


def bitmaps(sketch: DataFrame, bound: int, min_df: int, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """One row, one array of longs for each hash row: the bits of cells whose
    terms may be in the vocabulary. depth * width bits reach the driver."""
    bit = F.expr("shiftleft(1L, cast(cell % 64 AS int))")
    fits = (F.col("row") < depth) & (F.col("tf") >= bound) & (F.col("df") >= min_df)
    place = F.floor(F.col("cell") / 64).cast("int").alias("place")
    words = sketch.filter(fits).groupBy("row", place).agg(F.bit_or(bit).alias("bits")).collect()
    held = [[0] * ((width + 63) // 64) for _ in range(depth)]
    for w in words:
        held[w.row][w.place] = w.bits
    shape = ", ".join(f"m{r} array<long>" for r in range(depth))
    return sketch.sparkSession.createDataFrame([tuple(held)], shape)


def surviving(occurrences: DataFrame, maps: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The occurrences that no hash row bars."""

    def free(row: int) -> Column:
        cell = _cell(row, width)
        return F.getbit(F.get(f"m{row}", F.shiftright(cell, 6)), cell % 64) == 1

    met = occurrences.crossJoin(F.broadcast(maps))  # one row
    keep = free(0)
    for row in range(1, depth):
        keep = keep & free(row)
    return met.filter(keep).select("term", "is_new")


def frequent_vocabulary(
    documents: DataFrame,
    params: CascadeParams,
    store: StageStore,
    width: int = WIDTH,
    depth: int = DEPTH,
    naming_reports: int = NAMING_REPORTS,
) -> DataFrame:
    """term, tf, df, idf: what fit_vocabulary() gives, with the terms that can't
    be in it dropped before the shuffle. documents: report_id, terms."""
    candidates = store.put("candidate_terms", candidate_terms(documents, params.max_features, naming_reports))
    sketch = store.put("term_sketch", term_sketch(documents, candidates, width, depth))
    bound = lower_bound(sketch, params.max_features, params.min_df, depth)
    maps = bitmaps(sketch, bound, params.min_df, width, depth)
    left = surviving(term_occurrences(documents), maps, width, depth)
    stats = store.put("surviving_terms", counted_terms(left))
    return vocabulary(stats, documents.count(), params.max_features, params.min_df)
