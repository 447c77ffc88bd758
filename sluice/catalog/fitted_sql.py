"""SQL that fits the small models itself: Newton's method, step by step.

Three classes over two features of the embeddings. The SVM's steps solve the
3 x 3 system of the rows inside the margin (Cramer's rule); the sigmoids' steps
the 2 x 2 one. Both end at the unique optimum the library has to reach.
"""

from __future__ import annotations

SVM_STEPS, SIGMOID_STEPS = 16, 14
_SCALE = 16.0  # fixed: the query has the same

SMALL = f"""SELECT vec_id AS report_id, (vec_id % 5)::INT AS fold, {_SCALE} * embedding[1]::DOUBLE AS x0,
{_SCALE} * embedding[2]::DOUBLE AS x1, CASE WHEN vec_id % 11 = 0 THEN 'c' WHEN embedding[1] > 0.05 THEN 'a'
WHEN embedding[2] > 0.05 THEN 'b' ELSE 'c' END AS label FROM embeddings"""

_PROBLEMS = """SELECT o AS out, c, x0, x1, CASE WHEN label = c THEN 1.0 ELSE -1.0 END AS y,
CASE WHEN label = c THEN count(*) OVER (PARTITION BY o, c) / (3.0 * count(*) FILTER (label = c) OVER (PARTITION BY o, c))
ELSE 1.0 END AS s
FROM small, (SELECT unnest([0, 1, 2, 3, 4, -1]) AS o), (SELECT unnest(['a', 'b', 'c']) AS c) WHERE fold <> o"""

_NORMAL = """SELECT out, c, 1 + 2 * sum(s * x0 * x0) AS h00, 2 * sum(s * x0 * x1) AS h01, 2 * sum(s * x0) AS h02,
1 + 2 * sum(s * x1 * x1) AS h11, 2 * sum(s * x1) AS h12, 1 + 2 * sum(s) AS h22,
2 * sum(s * y * x0) AS g0, 2 * sum(s * y * x1) AS g1, 2 * sum(s * y) AS g2
FROM problems JOIN w{i} USING (out, c) WHERE 1 - y * (w0 * x0 + w1 * x1 + b) > 0 GROUP BY ALL"""

_SOLVED = """SELECT out, c,
(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS w0,
(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS w1,
(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS b
FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02)
+ h02 * (h01 * h12 - h11 * h02) AS det FROM h{i})"""

_HELD = """SELECT fold, report_id, c, w0 * x0 + w1 * x1 + b AS s, label = c AS own
FROM small JOIN svm ON out = fold"""

_TARGETS = """SELECT fold, c, s, CASE WHEN own THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t
FROM held JOIN (SELECT fold, c, (count(*) FILTER (own))::DOUBLE AS n1, (count(*) FILTER (NOT own))::DOUBLE AS n0
FROM held GROUP BY ALL) USING (fold, c)"""

_SUMS = """SELECT fold, c, any_value(a) AS a, any_value(b) AS b, sum((p - t) * s) AS ga, sum(p - t) AS gb,
sum(p * (1 - p) * s * s) AS haa, sum(p * (1 - p) * s) AS hab, sum(p * (1 - p)) AS hbb
FROM (SELECT *, 1 / (1 + exp(-(a * s + b))) AS p FROM targets JOIN s{i} USING (fold, c)) GROUP BY fold, c"""

_MOVED = """SELECT fold, c, a + (hab * gb - hbb * ga) / (haa * hbb - hab * hab) AS a,
b + (hab * ga - haa * gb) / (haa * hbb - hab * hab) AS b FROM q{i}"""


def _svm() -> dict[str, str]:
    parts = {
        "small": SMALL,
        "problems": _PROBLEMS,
        "w0": "SELECT DISTINCT out, c, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS b FROM problems",
    }
    for i in range(SVM_STEPS):
        parts |= {f"h{i}": _NORMAL.format(i=i), f"w{i + 1}": _SOLVED.format(i=i)}
    return parts | {"svm": f"SELECT * FROM w{SVM_STEPS}"}


def _sigmoids() -> dict[str, str]:
    parts = {
        **_svm(),
        "held": _HELD,
        "targets": _TARGETS,
        "s0": "SELECT fold, c, 0.0::DOUBLE AS a, ln(avg(t) / (1 - avg(t))) AS b FROM targets GROUP BY ALL",
    }
    for i in range(SIGMOID_STEPS):
        parts |= {f"q{i}": _SUMS.format(i=i), f"s{i + 1}": _MOVED.format(i=i)}
    return parts | {"sigmoids": f"SELECT * FROM s{SIGMOID_STEPS}"}


def _probable() -> dict[str, str]:
    return {
        **_sigmoids(),
        "each": """SELECT report_id, f.fold, v.c, 1 / (1 + exp(-(f.a * (v.w0 * x0 + v.w1 * x1 + v.b) + f.b))) AS p
FROM small, svm v JOIN sigmoids f ON v.out = f.fold AND v.c = f.c""",
        "means": """SELECT report_id, c, avg(p) AS p FROM (SELECT report_id, c,
p / sum(p) OVER (PARTITION BY report_id, fold) AS p FROM each) GROUP BY ALL""",
        "decided": "SELECT report_id, max_by(c, p) AS prediction, max(p) AS best FROM means GROUP BY report_id",
    }


def _sql(parts: dict[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items()) + "\n" + body


def fitted_oracles() -> dict[str, str]:
    return {
        "squared_hinge_svm": _sql(
            _svm(),
            """SELECT out AS fold, c AS label, round(any_value(w0), 5) AS w0, round(any_value(w1), 5) AS w1,
round(any_value(b), 5) AS intercept, round(any_value(w0 * w0 + w1 * w1 + b * b) / 2
+ sum(s * greatest(0, 1 - y * (w0 * x0 + w1 * x1 + b)) ** 2), 5) AS objective
FROM problems JOIN svm USING (out, c) GROUP BY out, c""",
        ),
        "sigmoid_calibration": _sql(
            _sigmoids(), "SELECT fold, c AS label, round(a, 5) AS slope, round(b, 5) AS intercept FROM sigmoids"
        ),
        "calibrated_probabilities": _sql(
            _probable(),
            """SELECT report_id, prediction, round(best, 5) AS best_probability,
round(max(CASE WHEN c = 'a' THEN p END), 5) AS p_a, round(max(CASE WHEN c = 'b' THEN p END), 5) AS p_b,
round(max(CASE WHEN c = 'c' THEN p END), 5) AS p_c
FROM means JOIN decided USING (report_id) GROUP BY ALL""",
        ),
        "fold_decisions": _sql(
            _svm(),
            """SELECT report_id, round(max(CASE WHEN c = 'a' THEN s END), 5) AS s_a,
round(max(CASE WHEN c = 'b' THEN s END), 5) AS s_b, round(max(CASE WHEN c = 'c' THEN s END), 5) AS s_c,
max_by(c, s) AS prediction FROM (SELECT report_id, c, w0 * x0 + w1 * x1 + b AS s FROM small, svm WHERE out = 0)
GROUP BY report_id""",
        ),
        "calibrated_quality": _sql(
            _probable(),
            """SELECT round(avg((prediction = label)::INT), 6) AS accuracy, round((SELECT avg(f1) FROM
(SELECT 2.0 * count(*) FILTER (prediction = l AND label = l) / (count(*) FILTER (prediction = l)
+ count(*) FILTER (label = l)) AS f1 FROM decided JOIN small USING (report_id),
(SELECT unnest(['a', 'b', 'c']) AS l) GROUP BY l)), 6) AS macro_f1 FROM decided JOIN small USING (report_id)""",
        ),
    }
