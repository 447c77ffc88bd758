"""Tokens, n-grams, windows and excerpts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is two or more letters, digits or underscores. The
# classes are spelled out because \w is ASCII-only on the JVM.
WORD_CLASS = r"\p{L}\p{N}_"
WORD_PATTERN = f"[{WORD_CLASS}]{{2,}}"

# Section headings looked for by focus_text, in priority order.
REPORT_ANCHORS = (
    "final diagnosis",
    "pathologic diagnosis",
    "diagnosis",
    "impression",
    "comment",
    "microscopic description",
)


def word_tokens(text: Column) -> Column:
    """Lower-case word tokens of a text; NULL text has none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def drop_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Tokens that are not in the list, order and repeats kept."""
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by the bigrams of neighbouring tokens."""
    pairs = F.zip_with(
        tokens,
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    # zip_with pads the shorter side with NULL, so the last pair is NULL.
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def add_terms(
    df: DataFrame, tokens: str, stop_words: Sequence[str], ngram_max: int
) -> DataFrame:
    """Replaces a column of tokens by `terms`: stop words go first, n-grams
    are formed after. Two projections, because the filtered tokens are used
    several times and must be computed once."""
    kept = df.withColumn(tokens, drop_stop_words(F.col(tokens), stop_words))
    column = with_bigrams(F.col(tokens)) if ngram_max == 2 else F.col(tokens)
    return kept.select(*[c for c in df.columns if c != tokens], column.alias("terms"))


def window_count(n_tokens: Column, size: int, overlap: int, cap: int | None) -> Column:
    """Closed form of 'advance by size - overlap until the end is reached';
    a text without tokens has one (empty) window."""
    step = size - overlap
    beyond = F.greatest(n_tokens - F.lit(size), F.lit(0))
    count = F.ceil(beyond / F.lit(float(step))).cast("int") + F.lit(1)
    return count if cap is None else F.least(count, F.lit(cap))


def token_windows(tokens: Column, size: int, overlap: int, cap: int | None) -> Column:
    """Array of overlapping token windows; element i starts at i * step."""
    step = size - overlap
    last = window_count(F.size(tokens), size, overlap, cap) - F.lit(1)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.slice(tokens, i * F.lit(step) + F.lit(1), F.lit(size)),
    )


def focus_text(
    text: Column,
    anchors: Sequence[str] = REPORT_ANCHORS,
    max_chars: int = 2000,
) -> Column:
    """Excerpt that starts at the first anchor of the list (list order, not
    position) found anywhere in the text, else at the beginning."""
    lowered = F.lower(text)
    hits = [F.nullif(F.instr(lowered, a), F.lit(0)) for a in anchors]
    start = F.coalesce(*hits, F.lit(1))
    return F.coalesce(F.substring(text, start, F.lit(max_chars)), F.lit(""))


def group_of(name: Column, separator: str = ".") -> Column:
    """Group id of a file name: what stands before the first separator."""
    return F.substring_index(name, separator, 1)
