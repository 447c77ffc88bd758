"""Request checks, fallback prompts and answers, response columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CHARS = 20

# Default wording; callers pass their own. {report} and {options} are
# replaced by columns.
PROMPT_TEMPLATE = (
    "Choose the one class that fits this report.\n\n"
    "Report:\n{report}\n\n"
    "Classes:\n{options}\n\n"
    "Answer with the class code and nothing else."
)


def reject_reason(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Why a request is refused, NULL for a good one."""
    return (
        F.when(text.isNull(), "missing")
        .when(F.length(text) < min_chars, "too_short")
        .when(~text.rlike(r"\S"), "blank")
    )


def display_names(codes: Column, names: Column) -> Column:
    """Names of an array of codes, looked up in a map column."""
    return F.transform(codes, lambda c: F.element_at(names, c))


def option_list(codes: Column, names: Column) -> Column:
    """One '- CODE: name' line per candidate, in candidate order."""
    lines = F.transform(
        codes,
        lambda c: F.concat(F.lit("- "), c, F.lit(": "), F.element_at(names, c)),
    )
    return F.array_join(lines, "\n")


def build_prompt(report: Column, options: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill a template's {report} and {options} slots with columns."""
    slots = {"{report}": report, "{options}": options}
    parts, rest = [], template
    while rest:
        found = sorted((rest.find(s), s) for s in slots if s in rest)
        if not found:
            parts.append(F.lit(rest))
            break
        at, slot = found[0]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(slots[slot])
        rest = rest[at + len(slot):]
    return F.concat(*parts)


def validated_answer(raw: Column, candidates: Column) -> Column:
    """First word of an answer in upper case if it is a candidate, else NULL.
    Punctuation is not stripped: 'BRCA.' is not an answer."""
    word = F.regexp_extract(F.upper(raw), r"\S+", 0)
    return F.when((word != "") & F.array_contains(candidates, word), word)


def encode_candidates(candidates: Column) -> Column:
    return F.array_join(candidates, ",")


def decode_candidates(stored: Column) -> Column:
    return F.split(stored, ",")


def prediction_id(run_id: str, report_id: Column) -> Column:
    """Same run and report give the same id, so a replay cannot add a row."""
    return F.sha2(F.concat_ws("|", F.lit(run_id), report_id.cast("string")), 256)


def confidence_band(score: Column, threshold: float) -> Column:
    """HIGH iff the unrounded score reaches the threshold."""
    return F.when(score >= F.lit(threshold), "HIGH").otherwise("LOW")


def reliability(routed_to: Column, was_valid: Column) -> Column:
    """High when the cascade decided or the fallback's answer was valid."""
    sure = (routed_to == "hybrid") | F.coalesce(was_valid, F.lit(False))
    return F.when(sure, "high").otherwise("low")
