import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sluice.functions import answers, text
from sluice.functions.words import NEGATIONS, STOP_WORDS, stop_words_without
from sluice.params import CascadeParams


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_group_of(spark):
    df = column(spark, ["a.b.c", "nodot", "", None])
    assert evaluate(df, text.group_of(F.col("v"))) == ["a", "nodot", "", None]


def test_reject_reason(spark):
    df = column(spark, ["x" * 19, "x" * 20, " " * 25, "\t\n" * 15, None])
    assert evaluate(df, answers.reject_reason(F.col("v"))) == [
        "too_short", None, "blank", "blank", "missing",
    ]


def test_focus_text_takes_anchors_in_list_order(spark):
    long = "a" * 3000
    df = column(spark, ["xx second yy first zz", "q SECOND r", "none here", None, long, "p first " + long])
    got = evaluate(df, text.focus_text(F.col("v"), ("first", "second"), 2000))
    assert got == ["first zz", "SECOND r", "none here", "", long[:2000], ("first " + long)[:2000]]


def test_default_anchors_put_specific_headings_first(spark):
    df = column(spark, ["comment: a. Final Diagnosis: b"])
    assert evaluate(df, text.focus_text(F.col("v"))) == ["Final Diagnosis: b"]


def test_word_tokens(spark):
    df = column(spark, ["A bc Über_1 x2 9 no", "", None, "a b c", "naïve-test"])
    got = evaluate(df, text.word_tokens(F.col("v")))
    assert got == [["bc", "über_1", "x2", "no"], [], [], [], ["naïve", "test"]]


def test_negations_stay():
    assert not set(NEGATIONS) & set(STOP_WORDS)
    assert list(STOP_WORDS) == sorted(set(STOP_WORDS))
    assert stop_words_without(["the", "no", "a"]) == ("a", "the")


@pytest.mark.parametrize("ngram_max", [1, 2])
def test_terms_form_bigrams_after_stop_words(spark, ngram_max):
    df = column(spark, [["no", "the", "tumor"], ["the"], [], ["a1", "b1", "c1"]], "array<string>")
    got = [r.terms for r in text.add_terms(df, "v", ("the",), ngram_max).orderBy("i").collect()]
    if ngram_max == 1:
        assert got == [["no", "tumor"], [], [], ["a1", "b1", "c1"]]
    else:
        assert got == [["no", "tumor", "no tumor"], [], [], ["a1", "b1", "c1", "a1 b1", "b1 c1"]]


def windows_by_loop(n, size, overlap, cap):
    spans, start = [], 0
    while start < n and (cap is None or len(spans) < cap):
        end = min(start + size, n)
        spans.append((start, end))
        if end == n:
            break
        start = end - overlap
    return spans or [(0, 0)]


@pytest.mark.parametrize("cap", [12, None])
def test_token_windows_equal_the_loop(spark, cap):
    lengths = [0, 1, 255, 256, 257, 448, 449, 640, 641, 2368, 2369, 5000]
    df = column(spark, [[str(i) for i in range(n)] for n in lengths], "array<string>")
    got = evaluate(df, text.token_windows(F.col("v"), 256, 64, cap))
    for n, windows in zip(lengths, got):
        expected = windows_by_loop(n, 256, 64, cap)
        assert [w[:1] + w[-1:] for w in windows] == [
            [str(a), str(b - 1)] if b else [] for a, b in expected
        ]
    counts = evaluate(df, F.size(text.token_windows(F.col("v"), 256, 64, 12)))
    assert counts == [1, 1, 1, 1, 2, 2, 3, 3, 4, 12, 12, 12]


def test_validated_answer(spark):
    raw = ["brca", " BRCA\n", "BRCA.", "BRCA is it", "LUAD", "  ", "", None]
    df = column(spark, raw)
    got = evaluate(df, answers.validated_answer(F.col("v"), F.array(F.lit("BRCA"), F.lit("READ"))))
    assert got == ["BRCA", "BRCA", None, "BRCA", None, None, None, None]


def test_prompt_and_options(spark):
    df = column(spark, ["{options} stays"])
    names = F.create_map(F.lit("A"), F.lit("apple"), F.lit("B"), F.lit("bee"))
    codes = F.array(F.lit("B"), F.lit("A"))
    options = answers.option_list(codes, names)
    got = evaluate(df, answers.build_prompt(F.col("v"), options, "<{report}|{options}>{report}"))
    assert got == ["<{options} stays|- B: bee\n- A: apple>{options} stays"]
    assert evaluate(df, answers.display_names(codes, names)) == [["bee", "apple"]]


def test_encoding_and_id(spark):
    df = column(spark, [["A", "B"]], "array<string>")
    stored = answers.encode_candidates(F.col("v"))
    assert evaluate(df, stored) == ["A,B"]
    assert evaluate(df, answers.decode_candidates(stored)) == [["A", "B"]]
    expected = hashlib.sha256(b"run|0").hexdigest()
    assert evaluate(df, answers.prediction_id("run", F.col("i"))) == [expected]


def test_band_uses_the_unrounded_score(spark):
    df = column(spark, [0.6, 0.59996, 1.0, math.nextafter(0.6, 0)], "double")
    assert evaluate(df, answers.confidence_band(F.col("v"), 0.6)) == ["HIGH", "LOW", "HIGH", "LOW"]


@pytest.mark.parametrize(
    "wrong", [{"threshold": 1.1}, {"window_overlap": 256}, {"max_windows": 0}, {"ngram_max": 3}]
)
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        CascadeParams(**wrong)


def test_parameters_round_trip():
    params = CascadeParams(max_windows=None, stop_words=("the",))
    assert CascadeParams.from_json(params.to_json()) == params
