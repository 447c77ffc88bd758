"""Secret scans: fixed patterns, and windowed entropy of candidate strings.

Only column expressions: no Python runs on the executors and no row moves. Base
kinds are regular expressions; where a match lies follows from the lengths of
the matches and of the texts between them. Beyond these, runs of 20 or more
characters of base64 that hold letters and digits are candidates. A window of 20
characters slides over each; character counts and the sum of c * log2(c) are
updated by the character that enters and the one that leaves, and the highest
entropy of any window is held against the threshold of the candidate's character
class, which finds 97 % or more of random keys of 20 characters and nearly all longer ones. Candidates on the allow-list (examples, UUIDs, digests that name
themselves, alphabets and counting runs) and those that touch a base span are
left out.

Defined cases: null text is empty. A text without a secret gives no span. Spans
are code points, end exclusive. Rows that repeat an id are scanned row by row.
An empty table gives an empty result. Other columns are not read. Very long texts
with many matches take time in proportion (running sums go by blocks).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds, in their order, and what a match must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 or more characters: matches are whole runs
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 or more

#: A whole run of 20 or more that holds a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Character class -> least entropy (bits a character) of some window. 98 % of
#: the windows of random strings over the class's alphabet have more: of 16, 36,
#: 62 and 66 characters (20,000 strings each, simulated). The last class, letters
#: of one case with signs between, is mostly words (paths, slugs): a higher bound.
CLASSES = (
    ("^[0-9a-f]+$|^[0-9A-F]+$", 2.95),
    ("^[a-z0-9]+$|^[A-Z0-9]+$", 3.44),
    ("^[A-Za-z0-9]+$", 3.68),
    ("(?=.*[a-z])(?=.*[A-Z])", 3.72),
    ("", 3.9),
)
ALLOWED = (
    "(?i)example|sample|dummy|placeholder|x{6}|0{6}|1234567|abcdefg|^sha(1|256|384|512)[-_=]"
    "|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
)
_BLOCK = 512


def _sums(values: Column) -> Column:
    """Running sums of one short array."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(
        values,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")
        ),
        lambda acc: acc["out"],
    )


def running_sums(values: Column) -> Column:
    """Running sums; blocks keep the cost in proportion to the array."""
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: _sums(F.slice(values, b * _BLOCK + 1, _BLOCK)))
    return F.flatten(
        F.aggregate(
            blocks,
            F.struct(
                F.lit(0).cast("long").alias("at"), F.array().cast("array<array<long>>").alias("out")
            ),
            lambda acc, block: F.struct(
                (acc["at"] + F.element_at(block, -1)).alias("at"),
                F.array_append(acc["out"], F.transform(block, lambda x: x + acc["at"])).alias("out"),
            ),
            lambda acc: acc["out"],
        )
    )


def _spans(hits: str, ends: str, rank: int) -> Column:
    """(start, rank, stop, hit) of each match."""
    return F.transform(
        hits,
        lambda hit, i: F.struct(
            (F.get(ends, i) - F.length(hit)).alias("start"),
            F.lit(rank).alias("rank"),
            F.get(ends, i).alias("stop"),
            hit.alias("hit"),
        ),
    )


def _weight(count: Column) -> Column:
    """c * log2(c) for a count of 0 to WINDOW."""
    return F.get(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)]), count)


def highest_entropy(candidate: Column) -> Column:
    """Highest entropy, in bits a character, of any window of the candidate
    (at least WINDOW characters of ALPHABET)."""
    places = F.transform(F.split(candidate, ""), lambda ch: F.position(ch, F.lit(ALPHABET)) - 1)
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(float("inf")).alias("least"),
        F.lit(0).alias("i"),
    )

    def slide(acc: Column, enters: Column) -> Column:
        i, counts = acc["i"], acc["counts"]
        leaves = F.when(i >= WINDOW, F.get(places, i - WINDOW)).otherwise(F.lit(-1))
        more, fewer = F.get(counts, enters), F.get(counts, F.greatest(leaves, F.lit(0)))
        grown = acc["sum"] + _weight(more + 1) - _weight(more)
        shrunk = F.when(leaves >= 0, _weight(fewer - 1) - _weight(fewer)).otherwise(0.0)
        total = F.when(leaves == enters, acc["sum"]).otherwise(grown + shrunk)
        moved = F.transform(
            counts,
            lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int"),
        )
        least = F.when(i >= WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(
            moved.alias("counts"), total.alias("sum"), least.alias("least"), (i + 1).alias("i")
        )

    return F.aggregate(places, start, slide, lambda acc: math.log2(WINDOW) - acc["least"] / WINDOW)


def _suspicious(candidate: Column) -> Column:
    least = F.lit(CLASSES[-1][1])
    for pattern, bound in reversed(CLASSES[:-1]):
        least = F.when(candidate.rlike(pattern), bound).otherwise(least)
    return F.when(
        candidate.rlike("[A-Za-z]") & candidate.rlike("[0-9]") & ~candidate.rlike(ALLOWED),
        highest_entropy(candidate) >= least,
    ).otherwise(False)


KINDS = ("assign", "access", "hex", "entropy")
_PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, rank of the kind in KINDS,
    stop), by start, then kind. base leaves out what the entropy adds."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.select(
        "doc_id",
        "text",
        *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in zip(KINDS, _PATTERNS)],
    )
    none = F.array().cast("array<bigint>")

    def ends(kind: str, pattern: str) -> Column:
        sizes = F.transform(
            F.slice(F.split("text", pattern, -1), 1, F.greatest(F.size(kind), F.lit(1))),
            lambda gap, i: (F.length(gap) + F.length(F.get(kind, i))).cast("long"),
        )
        return F.when(F.size(kind) > 0, running_sums(sizes)).otherwise(none).alias(f"{kind}_ends")

    placed = rows.select("doc_id", *KINDS, *[ends(k, p) for k, p in zip(KINDS, _PATTERNS)])
    enough = F.filter(
        _spans("assign", "assign_ends", 0),
        lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST,
    )
    found = placed.select(
        "doc_id",
        F.concat(enough, _spans("access", "access_ends", 1), _spans("hex", "hex_ends", 2)).alias("base"),
        _spans("entropy", "entropy_ends", 3).alias("more"),
    )
    added = F.filter(
        "more",
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        & _suspicious(s["hit"]),
    )

    def bare(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["stop"])))

    found = found.withColumn("added", added)
    return found.select(
        "doc_id", bare(F.col("base")).alias("base"), bare(F.concat("base", "added")).alias("spans")
    )


def as_text(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])), ","
    )


def count_of(spans: str, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
