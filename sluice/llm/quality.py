"""Quality classifier: kernel ridge by random Fourier features, calibrated.

Statistics of a whole text (lengths, character classes, repetition) are scaled
and mapped to random Fourier features, whose inner products approximate a
Gaussian kernel. Every task sums its part of the normal equations, the sums meet
in Spark, and the ridge solution of this small system is found on the driver.
Labelled rows that the fit has not seen calibrate the scores by isotonic
regression, over a histogram of fixed size.

Labels are the only thing learnt from; language, source and id are no inputs.

Defined cases: a null text is empty; an empty text has zero statistics and is
scored like any other. Rows with null or several labels: null labels are not
used, several count each. Without labelled rows every score is 1. A fold that is
empty leaves its step out (no calibration: the clipped ridge score). Rows that
repeat an id are scored row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import byte_texts, free_name, stage

FEATURES, RIDGE, SEED, BINS, THRESHOLD = 384, 1e-3, 7, 4096, 0.7
HELD_OUT, CALIBRATING = 2, 3
AT_ONCE = 1024

_LOWER = string.ascii_lowercase.encode()
_UPPER = string.ascii_uppercase.encode()
_DIGITS = string.digits.encode()
_SPACE = b" \t\n\v\f\r"
_STOPS = b".,;:'\"-"
_MARKS = bytes(set(string.punctuation.encode()) - set(_STOPS))

STATISTICS = (
    "words", "bytes", "word_length", "lower", "upper", "digits", "space", "stops", "marks", "wide",
    "lines", "distinct", "most_common", "same_as_before", "distinct_lines", "short", "long",
    "marked_words", "capitals", "distinct_pairs",
)


def statistics(text: bytes) -> list[float]:
    """Numbers named in STATISTICS; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)

    def share(characters: bytes) -> float:
        return (size - len(text.translate(None, characters))) / size

    counts = Counter(words)
    lines = text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    tails = Counter(w[-1:] for w in words)
    marked = sum(tails[m] for m in map(bytes, zip(_MARKS)))
    return [
        np.log1p(n),
        np.log1p(size),
        float(lengths.mean()),
        share(_LOWER),
        share(_UPPER),
        share(_DIGITS),
        share(_SPACE),
        share(_STOPS),
        share(_MARKS),
        1 - len(text.decode("utf-8", "ignore")) / size,
        len(lines) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        len(set(lines)) / len(lines),
        float((lengths <= 2).mean()),
        float((lengths >= 14).mean()),
        marked / n,
        sum(map(bytes.isupper, words)) / n,
        len(set(zip(words, words[1:]))) / n,
    ]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    rows = [statistics(t) for t in byte_texts(texts)]
    flat = np.array(rows, np.float32).reshape(-1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


@dataclass
class Model:
    """Scores statistics. `knots`, `levels`: the isotonic curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    constant: float | None = None
    features: int = FEATURES
    seed: int = SEED

    def __post_init__(self) -> None:
        draw = np.random.default_rng(self.seed)
        k = len(self.mean)
        self.directions = draw.normal(0, 1 / np.sqrt(k), (k, self.features))
        self.phases = draw.uniform(0, 2 * np.pi, self.features)

    def fourier(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / self.features)
        return np.hstack([waves, scaled, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        # Some rows at a time: the features are many times as wide.
        parts = [self.fourier(rows[k : k + AT_ONCE]) @ self.weights for k in range(0, len(rows), AT_ONCE)]
        return np.concatenate(parts) if parts else np.empty(0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        return np.interp(self.raw(rows), self.knots, self.levels)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


def _sums(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray] | None:
    """Normal equations of the labelled rows: summed in each task, then in
    groups of tasks, then over the groups."""
    shape = "fold int, gram binary, moment binary"

    def local(batches):
        width = model.features + len(STATISTICS) + 1
        gram, moment, fold = np.zeros((width, width)), np.zeros(width), None
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = batch.column("fold")[0].as_py() if fold is None else fold
            rows, marks = _matrix(batch.column("stats")), batch.column("label").to_numpy().astype(float)
            for k in range(0, len(rows), AT_ONCE):
                z = model.fourier(rows[k : k + AT_ONCE])
                gram += z.T @ z
                moment += z.T @ marks[k : k + AT_ONCE]
        if fold is not None:
            yield pa.RecordBatch.from_pydict(
                {"fold": pa.array([fold], pa.int32()), "gram": [gram.tobytes()], "moment": [moment.tobytes()]}
            )

    def together(table: pa.Table) -> pa.Table:
        sums = {
            c: sum(np.frombuffer(b) for b in table.column(c).to_pylist()).tobytes()
            for c in ("gram", "moment")
        }
        return pa.table({"fold": table.column("fold")[:1], "gram": [sums["gram"]], "moment": [sums["moment"]]})

    fold = F.pmod(F.spark_partition_id(), F.lit(16)).cast("int").alias("fold")
    parts = rows.select("stats", "label", fold).mapInArrow(local, shape)
    few = parts.groupBy("fold").applyInArrow(together, shape).collect()
    if not few:
        return None
    moment = sum(np.frombuffer(bytes(r.moment)) for r in few)
    gram = sum(np.frombuffer(bytes(r.gram)) for r in few).reshape(len(moment), -1)
    return gram, moment


def isotonic(totals: np.ndarray, counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: mean places and levels of the blocks."""
    blocks: list[list[float]] = []
    for total, count, place in zip(totals, counts, places):
        blocks.append([total, count, place * count])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return (
        np.array([b[2] / b[1] for b in blocks]),
        np.array([b[0] / b[1] for b in blocks]),
    )


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def fit(stats: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> Model:
    """stats: doc_id, stats (a stage table over all documents); labels: doc_id,
    label (0 or 1). Rows of fold HELD_OUT are never learnt from."""
    width = len(STATISTICS)
    cells = [F.element_at("stats", k + 1).cast("double") for k in range(width)]
    row = stats.agg(
        *[F.avg(c).alias(f"m{k}") for k, c in enumerate(cells)],
        *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(cells)],
    ).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(width)])
    scale = np.array([row[f"s{k}"] or 1.0 for k in range(width)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    known = labels.filter(F.col("label").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
    rows = stage(
        stats.sparkSession,
        "labelled",
        stats.join(known, "doc_id").select("stats", "label", fold_of(F.col("doc_id")).alias("part")),
    )
    sums = _sums(rows.filter(F.col("part") != CALIBRATING), model) or _sums(rows, model)
    if sums is None:
        model.constant = 1.0
        return model
    gram, moment = sums
    n = gram[-1, -1]
    model.weights = np.linalg.solve(gram + ridge * n * np.eye(len(gram)) / len(gram), moment)

    @F.arrow_udf(T.IntegerType())
    def bin_of(column: pa.Array) -> pa.Array:
        raw = np.clip(model.raw(_matrix(column)), -0.5, 1.5)
        return pa.array(np.minimum((raw + 0.5) / 2 * BINS, BINS - 1).astype(np.int32))

    bins = (
        rows.filter(F.col("part") == CALIBRATING)
        .groupBy(bin_of("stats").alias("bin"))
        .agg(F.sum("label").alias("total"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()
    )
    if bins:
        places = np.array([(r.bin + 0.5) * 2 / BINS - 0.5 for r in bins])
        knots, levels = isotonic(
            np.array([float(r.total) for r in bins]), np.array([float(r.n) for r in bins]), places
        )
        # The ends keep a slope, so that scores beyond the blocks keep their order.
        model.knots = np.concatenate([[-2.0], knots, [3.0]])
        model.levels = np.concatenate([[levels[0] * 0.9], levels, [1 - (1 - levels[-1]) * 0.9]])
    return model


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return stage(
        docs.sparkSession,
        "statistics",
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), statistics_of(text).alias("stats")),
    )


def scored(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(_matrix(column)))

    return stats.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        score("stats").alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept_documents(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents with a score of at least `threshold`, with all columns."""
    # The statistics are the work: they are written beside the row and read twice.
    name = free_name("stats", docs.columns)
    rows = stage(docs.sparkSession, "measured", docs.withColumn(name, statistics_of(text)))
    stats = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(name).alias("stats"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    @F.arrow_udf(T.BooleanType())
    def good(column: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(_matrix(column)) >= threshold)

    return rows.filter(good(name)).drop(name)
