"""The same answers in DuckDB SQL, over the same whole tables."""

from __future__ import annotations

from sluice.catalog.fitted_sql import fitted_oracles
from sluice.catalog.fixtures import ANCHORS, PARAMS
from sluice.functions.text import WORD_PATTERN
from sluice.params import REFERENCE_WINDOWS

P = PARAMS
T = P.threshold
STEP = P.window_step


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD_PATTERN}')"


def _kept(tokens: str, stop_words=P.stop_words) -> str:
    words = ", ".join(f"'{w}'" for w in stop_words)
    return f"list_filter({tokens}, lambda t: t NOT IN ({words}))"


def _terms(kept: str, ngram_max: int = P.ngram_max) -> str:
    if ngram_max == 1:
        return kept
    pairs = f"list_transform(range(1, len({kept})), lambda i: {kept}[i] || ' ' || {kept}[i + 1])"
    return f"list_concat({kept}, {pairs})"


def _hash(key: str, seed: int = P.seed) -> str:
    return f"md5('{seed}:' || {key})"


_REPORTS = "SELECT doc_id AS report_id, source AS group_id, text FROM documents"
_LABELS = (
    "SELECT d.doc_id AS report_id, upper(d.lang) || '-' || l.quality AS label "
    "FROM documents d JOIN labels l USING (doc_id)"
)
_CORPUS = "SELECT r.*, l.label FROM reports r JOIN marks l USING (report_id)"
_PLACES = f"""SELECT group_id, row_number() OVER (ORDER BY {_hash('group_id')}) AS place, count(*) OVER () AS g
FROM (SELECT DISTINCT group_id FROM corpus)"""
_SPLIT = f"""SELECT c.*, CASE WHEN place <= ceil({P.test_share}::DOUBLE * g) THEN 'test' ELSE 'train' END AS split
FROM corpus c JOIN places USING (group_id)"""

_THREE_WAY = f"""SELECT c.*, CASE WHEN place <= ceil({P.test_share}::DOUBLE * g) THEN 'test'
WHEN place <= ceil({P.test_share}::DOUBLE * g) + ceil(0.2::DOUBLE * g) THEN 'validation' ELSE 'train' END AS split
FROM corpus c JOIN places USING (group_id)"""


def _with(parts: dict[str, str], body: str) -> str:
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    return f"WITH {ctes}\n{body}"


_CORPUS_PARTS = {"reports": _REPORTS, "marks": _LABELS, "corpus": _CORPUS}
_SPLIT_PARTS = {**_CORPUS_PARTS, "places": _PLACES, "split_rows": _SPLIT}

_TOKEN_PARTS = {
    "reports": _REPORTS,
    "tokens": f"SELECT report_id, {_tokens('text')} AS tok FROM reports",
}
_TERM_PARTS = {
    **_TOKEN_PARTS,
    "kept": f"SELECT report_id, {_kept('tok')} AS k FROM tokens",
    "doc_terms": f"SELECT report_id, {_terms('k')} AS terms FROM kept",
}


def _vocabulary_parts(train: bool, max_features: int = P.max_features) -> dict[str, str]:
    """vocab: term, tf, df, idf over all reports or over the training side."""
    source = "SELECT report_id, unnest(terms) AS term FROM doc_terms"
    n = "(SELECT count(*) FROM reports)"
    if train:
        source += " WHERE report_id IN (SELECT report_id FROM split_rows WHERE split = 'train')"
        n = "(SELECT count(*) FROM split_rows WHERE split = 'train')"
    return {
        "occurrences": source,
        "stats": """SELECT term, sum(c)::BIGINT AS tf, count(*) AS df
FROM (SELECT report_id, term, count(*) AS c FROM occurrences GROUP BY ALL) GROUP BY term""",
        "vocab": f"""SELECT term, tf, df, ln(({n} + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf
FROM stats WHERE df >= {P.min_df} ORDER BY tf DESC, term LIMIT {max_features}""",
    }


_WHOLE_VOCAB = {**_TERM_PARTS, **_vocabulary_parts(train=False)}

_MODEL = {
    **_SPLIT_PARTS,
    **{k: v for k, v in _TERM_PARTS.items() if k != "reports"},
    **_vocabulary_parts(train=True),
    "train_w": """SELECT o.report_id, o.term, count(*) * any_value(v.idf) AS w
FROM occurrences o JOIN vocab v USING (term) GROUP BY o.report_id, o.term""",
    "train_unit": "SELECT report_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY report_id)) AS w FROM train_w",
    "sizes": "SELECT label, count(*) AS n FROM split_rows WHERE split = 'train' GROUP BY label",
    "means": """SELECT label, term, sum(w) / any_value(n) AS w
FROM train_unit JOIN split_rows USING (report_id) JOIN sizes USING (label) GROUP BY label, term""",
    "centroids": "SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM means",
}


def _scored(max_windows: int | None = P.max_windows) -> dict[str, str]:
    """scores: report_id, chunk_index, label, score; chunk -1 is the report."""
    count = f"1 + ceil(greatest(len(tok) - {P.window_tokens}, 0) / {float(STEP)}::DOUBLE)::INT"
    if max_windows is not None:
        count = f"least({count}, {max_windows})"
    return {
        **_MODEL,
        "windows": f"""SELECT report_id, i::INT AS chunk_index,
list_slice(tok, i * {STEP} + 1, i * {STEP} + {P.window_tokens}) AS tok
FROM (SELECT report_id, tok, unnest(range(0, {count})) AS i FROM tokens)""",
        "units": """SELECT report_id, -1 AS chunk_index, tok FROM tokens
UNION ALL SELECT report_id, chunk_index, tok FROM windows""",
        "unit_kept": f"SELECT report_id, chunk_index, {_kept('tok')} AS k FROM units",
        "unit_terms": f"SELECT report_id, chunk_index, unnest({_terms('k')}) AS term FROM unit_kept",
        "unit_w": """SELECT report_id, chunk_index, term, count(*) * any_value(idf) AS w
FROM unit_terms JOIN vocab USING (term) GROUP BY report_id, chunk_index, term""",
        "norms": "SELECT report_id, chunk_index, sqrt(sum(w * w)) AS norm FROM unit_w GROUP BY ALL",
        "dots": """SELECT u.report_id, u.chunk_index, c.label, sum(u.w * c.w) AS dot
FROM unit_w u JOIN centroids c USING (term) GROUP BY ALL""",
        "scores": """SELECT a.report_id, a.chunk_index, s.label, coalesce(d.dot / n.norm, 0) AS score
FROM (SELECT report_id, chunk_index FROM units) a CROSS JOIN sizes s
LEFT JOIN dots d ON d.report_id = a.report_id AND d.chunk_index = a.chunk_index AND d.label = s.label
LEFT JOIN norms n ON n.report_id = a.report_id AND n.chunk_index = a.chunk_index""",
        "ranked": f"""SELECT report_id, label, score, row_number() OVER
(PARTITION BY report_id ORDER BY round(score, {P.tie_decimals}) DESC, label) AS rank
FROM scores WHERE chunk_index = -1""",
        "cands": f"SELECT report_id, label, rank FROM ranked WHERE rank <= {P.top_k}",
    }


_SCORED = _scored()


def _decided(scored: dict[str, str]) -> dict[str, str]:
    return {
        **scored,
        "chosen": """SELECT s.report_id, s.chunk_index, s.label, c.rank, s.score,
max(s.score) OVER (PARTITION BY s.report_id, s.chunk_index) AS top
FROM scores s JOIN cands c USING (report_id, label) WHERE s.chunk_index >= 0""",
        "probs": f"""SELECT report_id, chunk_index, label, rank,
exp({P.softmax_scale}::DOUBLE * (score - top)) / sum(exp({P.softmax_scale}::DOUBLE * (score - top)))
OVER (PARTITION BY report_id, chunk_index) AS p FROM chosen""",
        "evidence": f"""SELECT report_id, chunk_index, label AS top_label, p AS score FROM probs
QUALIFY row_number() OVER (PARTITION BY report_id, chunk_index ORDER BY round(p, {P.tie_decimals}) DESC, rank) = 1""",
        "decisions": f"""SELECT report_id, top_label AS hybrid_label, score FROM evidence
QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY round(score, {P.tie_decimals}) DESC, chunk_index) = 1""",
    }


_DECIDED = _decided(_SCORED)


def _routed(decided: dict[str, str], threshold: float = T, checked: bool = True) -> dict[str, str]:
    """routed: report_id, prediction, score, routed_to; by mean probability
    below the threshold."""
    good = (
        "SELECT report_id FROM reports WHERE length(text) >= 20 AND regexp_matches(text, '\\S')"
        if checked
        else "SELECT report_id FROM reports"
    )
    return {
        **decided,
        "good": good,
        "mean_p": f"""SELECT report_id, label FROM (SELECT report_id, label, any_value(rank) AS rank, avg(p) AS m
FROM probs GROUP BY report_id, label)
QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY round(m, {P.tie_decimals}) DESC, rank) = 1""",
        "routed": f"""SELECT d.report_id, d.score,
CASE WHEN d.score >= {threshold}::DOUBLE THEN d.hybrid_label ELSE m.label END AS prediction,
CASE WHEN d.score >= {threshold}::DOUBLE THEN 'hybrid' ELSE 'window_mean' END AS routed_to
FROM decisions d JOIN mean_p m USING (report_id) JOIN good USING (report_id)""",
        "cand_lists": "SELECT report_id, string_agg(label, ',' ORDER BY rank) AS candidates FROM cands GROUP BY report_id",
    }


_ROUTED = _routed(_DECIDED)
_ID = "sha256('run-1|' || report_id)"

_ANCHOR_HITS = ", ".join(f"nullif(instr(lower(text), '{a}'), 0)" for a in ANCHORS)
_FOCUS = f"coalesce(substr(text, coalesce({_ANCHOR_HITS}, 1), 2000), '')"

_TRUTH = """SELECT doc_id AS report_id, lang AS y_true, (doc_id * 37 % 100) / 100.0::DOUBLE AS confidence
FROM documents"""
_PREDS = """SELECT 'base' AS model, doc_id AS report_id, CASE WHEN doc_id % 10 < 8 THEN lang ELSE 'en' END AS pred FROM documents
UNION ALL SELECT 'model_a', doc_id, CASE WHEN doc_id % 7 < 6 THEN lang ELSE 'fr' END FROM documents
UNION ALL SELECT 'model_b', doc_id, 'en' FROM documents"""
_REGISTRY = """SELECT * FROM (VALUES ('base', true, true, 0), ('model_a', false, true, 1),
('model_b', false, false, 2), ('model_c', false, true, 3)) AS r(model, is_baseline, is_local, registry_order)"""
_JOINED = f"""SELECT p.model, t.report_id, t.y_true, t.confidence, p.pred, b.pred AS base_pred,
CASE WHEN t.confidence >= {T}::DOUBLE THEN 'HIGH' ELSE 'LOW' END AS band
FROM truth t JOIN preds p USING (report_id) JOIN preds b ON b.report_id = t.report_id AND b.model = 'base'"""
_EVAL = {"truth": _TRUTH, "preds": _PREDS, "registry": _REGISTRY, "joined": _JOINED}

_LEVELED = """SELECT * FROM joined UNION ALL
SELECT model, report_id, y_true, confidence, pred, base_pred, 'ALL' FROM joined"""


def _class_table(source: str, *keys: str) -> dict[str, str]:
    k = ", ".join(keys)
    return {
        "sides": f"""SELECT {k}, y_true AS label, 1 AS support, 0 AS predicted, (y_true = pred)::INT AS tp FROM {source}
UNION ALL SELECT {k}, pred, 0, 1, 0 FROM {source}""",
        "class_table": f"""SELECT {k}, label, sum(tp)::BIGINT AS tp, (sum(predicted) - sum(tp))::BIGINT AS fp,
(sum(support) - sum(tp))::BIGINT AS fn, sum(support)::BIGINT AS support,
CASE WHEN sum(predicted) > 0 THEN sum(tp) / sum(predicted)::DOUBLE ELSE 0 END AS precision,
CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support)::DOUBLE ELSE 0 END AS recall,
2 * sum(tp) / (sum(support) + sum(predicted))::DOUBLE AS f1 FROM sides GROUP BY {k}, label""",
        "f1s": f"""SELECT {k}, avg(f1) AS macro_f1, sum(f1 * support) / sum(support)::DOUBLE AS weighted_f1
FROM class_table GROUP BY {k}""",
    }


_LOG = """SELECT event_id::VARCHAR AS id,
CASE WHEN event_type IN ('click', 'view') THEN 'hybrid' ELSE event_type END AS routed_to,
CASE WHEN event_type = 'error' THEN 'low' ELSE 'high' END AS reliability,
(event_id * 37 % 100) / 100.0::DOUBLE AS routing_score, trunc(value)::INT AS latency_ms, ts AS created_at FROM events"""


def _metrics(extra: str = "") -> str:
    return f"""count(id) AS total_requests,
count(*) FILTER (routed_to = 'hybrid') AS routed_to_hybrid,
count(*) FILTER (routed_to <> 'hybrid') AS routed_to_fallback,
count(*) FILTER (reliability = 'low') AS low_reliability_count,
coalesce(round(count(*) FILTER (routed_to <> 'hybrid') / nullif(count(id), 0)::DOUBLE, 4), 0) AS fallback_rate,
coalesce(round(count(*) FILTER (reliability = 'low') / nullif(count(id), 0)::DOUBLE, 4), 0) AS low_reliability_rate,
coalesce(round(avg(latency_ms), 2), 0) AS avg_latency_ms,
coalesce(round(avg(routing_score), 4), 0) AS avg_routing_score,
coalesce(round(quantile_cont(latency_ms, 0.5), 2), 0) AS p50_latency_ms,
coalesce(round(quantile_cont(latency_ms, 0.95), 2), 0) AS p95_latency_ms{extra}"""


_WINDOWED = """count(*) AS total_requests,
count(*) FILTER (routed_to = 'hybrid') AS routed_to_hybrid,
count(*) FILTER (reliability = 'low') AS low_reliability_count,
round(avg(latency_ms), 2) AS avg_latency_ms, round(avg(routing_score), 4) AS avg_routing_score,
round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms,
round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms"""

_NAMES = "map {'en': 'English', 'fr': 'French', 'de': 'German'}"
_RAW = """SELECT doc_id AS report_id, CASE doc_id % 7
WHEN 0 THEN upper(lang) WHEN 1 THEN ' ' || lang || chr(10) WHEN 2 THEN upper(lang) || '.'
WHEN 3 THEN upper(lang) || ' is it' WHEN 4 THEN 'XX' WHEN 5 THEN '  ' || chr(9) END AS raw FROM documents"""
_FIRST_WORD = "regexp_extract(upper(raw), '\\S+')"
_DIM_NAME = "'documents in ' || split_part(label, '-', 1) || ' of quality ' || split_part(label, '-', 2)"


def oracles() -> dict[str, str]:
    sql: dict[str, str] = fitted_oracles()

    # sources and sinks
    sql["scan_reports"] = _REPORTS
    sql["scan_labels"] = _LABELS
    sql["csv_round_trip"] = """SELECT source || '.' || doc_id || '.txt' AS report_id, source AS group_id,
length(text) AS n_chars, md5(text) AS digest FROM documents"""
    sql["label_dimension"] = _with(
        {"marks": _LABELS},
        f"SELECT label AS code, {_DIM_NAME} AS label_name, label AS code_again, count(*) AS n FROM marks GROUP BY label",
    )
    sql["label_names"] = _with({"marks": _LABELS}, f"SELECT report_id, {_DIM_NAME} AS label_name FROM marks")
    sql["label_codes"] = _with({"marks": _LABELS}, "SELECT report_id, label AS code FROM marks")
    sql["append_prediction_log"] = _with(
        {"log": _LOG},
        """SELECT id, upper(routed_to) AS prediction_label, routing_score, latency_ms,
routed_to || ',other' AS stored_candidates, created_at::DATE::VARCHAR AS created_date FROM log""",
    )
    sql["saved_model_round_trip"] = "SELECT count(*) AS n_reports, 0::BIGINT AS n_different FROM documents"
    sql["read_evaluation_store"] = _with(_EVAL, "SELECT model, report_id, pred FROM preds")
    sql["upsert_evaluation_store"] = _with(
        _EVAL,
        """SELECT model, report_id, pred FROM preds WHERE model <> 'model_b'
UNION ALL SELECT 'model_b', report_id, y_true FROM truth""",
    )
    sql["pending_predictions"] = """SELECT 'model_a' AS model, doc_id AS report_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""

    # projections and predicates
    sql["group_of_name"] = "SELECT doc_id, split_part(source || '.' || doc_id || '.txt', '.', 1) AS group_id FROM documents"
    sql["drop_missing_labels"] = _with(_CORPUS_PARTS, "SELECT report_id, label FROM corpus WHERE text IS NOT NULL")
    sql["request_check"] = """SELECT doc_id AS report_id, CASE WHEN text IS NULL THEN 'missing'
WHEN length(text) < 20 THEN 'too_short' WHEN NOT regexp_matches(text, '\\S') THEN 'blank' END AS reason FROM documents"""
    sql["confidence_bands"] = _with(
        {"truth": _TRUTH},
        f"SELECT report_id, CASE WHEN confidence >= {T}::DOUBLE THEN 'HIGH' ELSE 'LOW' END AS band FROM truth",
    )
    sql["focused_text"] = f"SELECT doc_id AS report_id, {_FOCUS} AS excerpt FROM documents"
    sql["candidate_names"] = "SELECT doc_id AS report_id, 'English; French; German' AS names FROM documents"
    sql["fallback_prompts"] = """SELECT doc_id AS report_id, 'Text:' || chr(10) || text || chr(10) || chr(10) || 'Options:' || chr(10)
|| '- fr: French' || chr(10) || '- en: English' || chr(10) || '- de: German' || chr(10) || chr(10) || 'Code:' AS prompt
FROM documents"""
    sql["validated_answers"] = _with(
        {"raws": _RAW, "words": f"SELECT report_id, {_FIRST_WORD} AS w FROM raws"},
        "SELECT report_id, CASE WHEN w IN ('EN', 'FR', 'DE') THEN w END AS answer FROM words",
    )
    sql["encoded_candidates"] = "SELECT doc_id AS report_id, 'en,fr,de' AS stored, 'fr' AS second FROM documents"
    sql["prediction_ids"] = "SELECT doc_id AS report_id, sha256('run-1|' || doc_id) AS prediction_id FROM documents"
    sql["selected_reports"] = """SELECT doc_id AS report_id, source AS group_id FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)"""

    # joins and splits
    sql["labelled_corpus"] = _with(
        _CORPUS_PARTS, "SELECT report_id, group_id, label, length(text) AS n_chars FROM corpus"
    )
    sql["group_label_join"] = _with(
        _CORPUS_PARTS,
        """SELECT r.report_id, r.group_id, g.label FROM reports r JOIN
(SELECT group_id, unnest([min(label), max(label)]) AS label FROM corpus GROUP BY group_id) g USING (group_id)""",
    )
    sql["duplicate_labels"] = _with(
        _CORPUS_PARTS,
        "SELECT group_id, count(*) AS n_labels FROM corpus GROUP BY group_id HAVING count(*) > 1",
    )
    sql["leakage_check"] = _with(
        _SPLIT_PARTS,
        """SELECT count(*) AS leaked_groups FROM
(SELECT group_id FROM split_rows GROUP BY group_id HAVING count(DISTINCT split) > 1)""",
    )
    sql["aligned_predictions"] = _with(_EVAL, "SELECT model, report_id, y_true, pred, confidence FROM joined")
    sql["alignment_report"] = _with(
        {**_EVAL, "marks": _LABELS,
         "part": "SELECT p.* FROM preds p JOIN documents d ON d.doc_id = p.report_id WHERE d.lang <> 'fr'"},
        """SELECT model, count(m.report_id) AS matched, count(*) FILTER (m.report_id IS NULL) AS only_in_predictions,
(SELECT count(*) FROM marks) - count(m.report_id) AS only_in_truth
FROM part LEFT JOIN marks m USING (report_id) GROUP BY model""",
    )
    sql["group_split"] = _with(_SPLIT_PARTS, "SELECT report_id, group_id, split FROM split_rows")
    sql["validation_split"] = _with(
        {**_CORPUS_PARTS, "places": _PLACES, "split_rows": _THREE_WAY}, "SELECT report_id, split FROM split_rows"
    )
    sql["split_report"] = _with(
        _SPLIT_PARTS,
        """SELECT split, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, count(DISTINCT label) AS n_classes
FROM split_rows GROUP BY split""",
    )
    sql["fixed_subset"] = f"SELECT doc_id AS report_id FROM documents ORDER BY {_hash('doc_id')} LIMIT 300"
    sql["stratified_folds"] = _with(
        {"marks": _LABELS},
        f"""SELECT report_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {_hash('report_id')}) - 1) % 5)::INT AS fold
FROM marks""",
    )
    sql["stratified_group_folds"] = _with(
        _CORPUS_PARTS,
        """SELECT group_id AS name, count(*) AS n_rows, 1::BIGINT AS n_folds, true AS balanced FROM corpus GROUP BY ALL
UNION ALL SELECT label, count(*), 5, true FROM corpus GROUP BY ALL""",
    )
    sql["group_folds"] = f"""SELECT doc_id AS report_id, (('0x' || substr({_hash('source')}, 1, 8))::BIGINT % 5)::INT AS fold
FROM documents"""
    sql["corpus_profile"] = _with(
        _CORPUS_PARTS,
        """SELECT count(*) AS n_reports, count(DISTINCT label) AS n_labels, count(DISTINCT group_id) AS n_groups,
(SELECT max(c) FROM (SELECT count(*) AS c FROM corpus GROUP BY group_id)) AS max_per_group FROM corpus""",
    )

    # text features
    sql["word_tokens"] = _with(
        _TOKEN_PARTS, "SELECT report_id, len(tok) AS n_tokens, md5(array_to_string(tok, ' ')) AS digest FROM tokens"
    )
    sql["stop_word_filter"] = _with(
        _TERM_PARTS, "SELECT report_id, len(k) AS n_kept, md5(array_to_string(k, ' ')) AS digest FROM kept"
    )
    sql["report_ngrams"] = _with(
        _TERM_PARTS,
        "SELECT report_id, len(terms) AS n_terms, md5(array_to_string(terms, '|')) AS digest FROM doc_terms",
    )
    sql["term_statistics"] = _with(_WHOLE_VOCAB, f"SELECT term, tf, df FROM stats WHERE df >= {P.min_df}")
    backend = "CASE WHEN event_type IN ('click', 'view') THEN 'hybrid' ELSE event_type END"
    sql["stream_first_predictions"] = f"""SELECT 'first' AS status, {backend} AS routed_to, count(*) AS n
FROM events GROUP BY ALL UNION ALL SELECT 'conflict', 'other', count(*) FROM events WHERE event_id % 10 = 0"""
    sql["stream_late_rows"] = f"""WITH e AS (SELECT *, {backend} AS b,
ts < TIMESTAMP '2024-01-15' AND event_id % 7 = 0 AS late FROM events),
m AS (SELECT epoch(date_trunc('second', max(ts) - INTERVAL 1 DAY))::BIGINT AS mark FROM e WHERE NOT late)
SELECT CASE WHEN late THEN 'behind the watermark' ELSE 'logged' END AS kind, b AS routed_to, count(*) AS n,
sum(CASE WHEN late THEN mark - epoch(date_trunc('second', ts))::BIGINT ELSE 0 END)::BIGINT AS seconds_behind
FROM e, m GROUP BY ALL"""
    of = "count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events"
    sql["sketched_percentiles"] = f"""SELECT event_type AS routed_to, {of} GROUP BY event_type
UNION ALL SELECT 'all', {of}"""
    sql["vocabulary"] = _with(_WHOLE_VOCAB, "SELECT term, tf, df, round(idf, 6) AS idf FROM vocab")
    sql["vocabulary_cap"] = _with(
        {**_TERM_PARTS, **_vocabulary_parts(train=False, max_features=5_000)}, "SELECT term, tf, df FROM vocab"
    )
    sql["frequent_vocabulary"] = _with(
        {**_TERM_PARTS, **_vocabulary_parts(train=False, max_features=5_000)},
        "SELECT term, tf, df, round(idf, 6) AS idf FROM vocab",
    )
    sql["vocabulary_size"] = _with(_WHOLE_VOCAB, "SELECT count(*) AS n_terms FROM vocab")
    per_report = """SELECT o.report_id, o.term, count(*) AS tf, any_value(v.idf) AS idf
FROM occurrences o JOIN vocab v USING (term) GROUP BY o.report_id, o.term"""
    sql["vocabulary_match"] = _with(
        {**_WHOLE_VOCAB, "known": per_report},
        """SELECT report_id, count(*) AS n_known, sum(tf)::BIGINT AS n_occurrences, round(sum(tf * idf), 4) AS weight
FROM known GROUP BY report_id""",
    )
    sql["tfidf_vectors"] = _with(
        {**_WHOLE_VOCAB, "known": per_report,
         "unit": "SELECT report_id, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY report_id)) AS w FROM known"},
        """SELECT report_id, count(*) AS n_entries, round(sum(w), 4) AS sum_w, round(max(w), 6) AS max_w
FROM unit GROUP BY report_id""",
    )
    sql["token_windows"] = _with(
        _SCORED,
        "SELECT report_id, chunk_index, len(tok) AS n_tokens, md5(array_to_string(tok, ' ')) AS digest FROM windows",
    )
    sql["token_windows_reference_cap"] = _with(
        _scored(REFERENCE_WINDOWS),
        "SELECT report_id, chunk_index, len(tok) AS n_tokens FROM windows",
    )
    reach = P.window_tokens + 11 * STEP
    sql["window_coverage"] = _with(
        _TOKEN_PARTS,
        f"""SELECT count(*) AS n_reports, round(avg((len(tok) > 512)::INT), 6) AS share_over_limit,
round(avg((len(tok) > {reach})::INT), 6) AS share_over_cap,
sum(greatest(len(tok) - {reach}, 0))::BIGINT AS tokens_over_cap,
sum(1 + ceil(greatest(len(tok) - {P.window_tokens}, 0) / {float(STEP)}::DOUBLE))::BIGINT AS n_windows FROM tokens""",
    )

    # stage 1
    sql["class_weights"] = _with(
        {"marks": _LABELS, "counts": "SELECT label, count(*) AS n FROM marks GROUP BY label"},
        """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM counts""",
    )
    sql["class_centroids"] = _with(
        _MODEL,
        """SELECT label, count(*) AS n_entries, round(sum(w), 4) AS sum_w, round(max(w), 6) AS max_w
FROM centroids GROUP BY label""",
    )
    sql["class_scores"] = _with(
        _SCORED, "SELECT report_id, label, round(score, 5) AS score FROM scores WHERE chunk_index = -1"
    )
    sql["top_candidates"] = _with(_ROUTED, "SELECT report_id, candidates FROM cand_lists")
    sql["top_candidates_long"] = _with(_SCORED, "SELECT report_id, rank, label FROM cands")
    sql["hard_predictions"] = _with(_SCORED, "SELECT report_id, label AS prediction FROM cands WHERE rank = 1")
    sql["candidate_recall"] = _with(
        {**_SCORED, "found": """SELECT s.report_id, c.rank FROM split_rows s
LEFT JOIN cands c ON c.report_id = s.report_id AND c.label = s.label WHERE s.split = 'test'"""},
        f"""SELECT k::INT AS k, round((SELECT count(*) FROM found WHERE rank <= k) / (SELECT count(*) FROM found)::DOUBLE, 6) AS recall
FROM range(1, {P.top_k + 1}) t(k)""",
    )
    sql["vector_centroids"] = """WITH cells AS (SELECT label::VARCHAR AS label, unnest(range(0, len(embedding)))::INT AS pos,
unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, pos, count(*) AS n_rows, avg(x) AS m FROM cells GROUP BY label, pos)
SELECT label, n_rows, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 4) AS w FROM means"""

    # stage 2
    sql["window_candidates"] = _with(
        _SCORED,
        "SELECT w.report_id, w.chunk_index, c.rank::INT AS rank, c.label FROM windows w JOIN cands c USING (report_id)",
    )
    sql["window_evidence"] = _with(
        _DECIDED, "SELECT report_id, chunk_index, top_label, round(score, 4) AS score FROM evidence"
    )
    sql["window_probabilities"] = _with(
        _DECIDED, "SELECT report_id, chunk_index, label, round(p, 4) AS probability FROM probs"
    )
    sql["best_windows"] = _with(
        _DECIDED, "SELECT report_id, hybrid_label, round(score, 4) AS score FROM decisions"
    )
    sql["explanations"] = _with(
        _DECIDED,
        """SELECT report_id, count(*) AS n_windows,
md5(string_agg(array_to_string(tok, ' '), '|' ORDER BY chunk_index)) AS texts,
string_agg(top_label, ',' ORDER BY chunk_index) AS labels
FROM windows JOIN evidence USING (report_id, chunk_index) GROUP BY report_id""",
    )
    sql["evidence_by_id"] = _with(
        _DECIDED,
        """SELECT report_id, chunk_index, md5(array_to_string(tok, ' ')) AS chunk_text, top_label, round(score, 4) AS score
FROM windows JOIN evidence USING (report_id, chunk_index)
WHERE report_id IN (SELECT report_id FROM decisions ORDER BY round(score, 4), report_id LIMIT 100)""",
    )
    sql["own_window_scorer"] = _with(
        {**_SCORED,
         "raws": """SELECT w.report_id, w.chunk_index, c.label, c.rank,
len(list_filter(w.tok, lambda t: t = lower(split_part(c.label, '-', 1))))::DOUBLE AS s
FROM windows w JOIN cands c USING (report_id)""",
         "own": """SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p FROM raws
WINDOW w AS (PARTITION BY report_id, chunk_index)"""},
        f"""SELECT report_id, chunk_index, label AS top_label, round(p, 4) AS score FROM own
QUALIFY row_number() OVER (PARTITION BY report_id, chunk_index ORDER BY round(p, {P.tie_decimals}) DESC, rank) = 1""",
    )

    # routing
    sql["threshold_routing"] = _with(
        _DECIDED,
        f"SELECT report_id, CASE WHEN score >= {T}::DOUBLE THEN 'hybrid' ELSE 'fallback' END AS routed_to FROM decisions",
    )
    every = _routed(_DECIDED, checked=False)
    sql["fallback_window_mean"] = _with(
        every,
        "SELECT report_id, prediction AS answer, true AS was_valid FROM routed WHERE routed_to = 'window_mean'",
    )
    excerpt_parts = {
        **_DECIDED,
        "excerpts": f"SELECT report_id, {_tokens(_FOCUS)} AS tok FROM reports",
        "ex_kept": f"SELECT report_id, {_kept('tok')} AS k FROM excerpts",
        "ex_terms": f"SELECT report_id, unnest({_terms('k')}) AS term FROM ex_kept",
        "ex_w": """SELECT report_id, term, count(*) * any_value(idf) AS w
FROM ex_terms JOIN vocab USING (term) GROUP BY report_id, term""",
        "ex_norm": "SELECT report_id, sqrt(sum(w * w)) AS norm FROM ex_w GROUP BY report_id",
        "ex_dot": "SELECT e.report_id, c.label, sum(e.w * c.w) AS dot FROM ex_w e JOIN centroids c USING (term) GROUP BY ALL",
        "ex_best": f"""SELECT c.report_id, c.label FROM cands c LEFT JOIN ex_dot d USING (report_id, label)
LEFT JOIN ex_norm n ON n.report_id = c.report_id
QUALIFY row_number() OVER (PARTITION BY c.report_id
ORDER BY round(coalesce(d.dot / n.norm, 0), {P.tie_decimals}) DESC, c.rank) = 1""",
    }
    sql["fallback_focused_text"] = _with(
        excerpt_parts,
        f"""SELECT report_id, label AS answer, true AS was_valid FROM ex_best
JOIN decisions USING (report_id) WHERE score < {T}::DOUBLE""",
    )
    sql["fallback_retry"] = _with(
        {"raws": _RAW,
         "first": f"SELECT report_id, {_FIRST_WORD} AS w FROM raws",
         "second": """SELECT report_id, CASE WHEN report_id % 7 = 2 THEN
regexp_extract(replace(upper(raw), '.', ''), '\\S+') END AS w FROM raws"""},
        """SELECT report_id, CASE WHEN f.w IN ('EN', 'FR', 'DE') THEN f.w WHEN s.w IN ('EN', 'FR', 'DE') THEN s.w
ELSE 'EN' END AS answer,
coalesce(f.w IN ('EN', 'FR', 'DE'), false) OR coalesce(s.w IN ('EN', 'FR', 'DE'), false) AS was_valid,
CASE WHEN f.w IN ('EN', 'FR', 'DE') THEN 1 ELSE 2 END AS attempts FROM first f JOIN second s USING (report_id)""",
    )
    sql["python_scorer"] = f"""SELECT doc_id AS report_id, ['EN', 'FR', 'DE'][length(text) % 3 + 1] AS answer
FROM documents WHERE (doc_id * 37 % 100) / 100.0::DOUBLE < {T}::DOUBLE"""
    sql["classify_reports"] = _with(
        _ROUTED,
        f"""SELECT report_id, {_ID} AS prediction_id, prediction, round(score, 4) AS routing_score, routed_to,
'high' AS reliability, candidates AS top_k_candidates FROM routed JOIN cand_lists USING (report_id)""",
    )
    sql["classify_reference_cap"] = _with(
        _routed(_decided(_scored(REFERENCE_WINDOWS))),
        "SELECT report_id, prediction, routed_to FROM routed",
    )
    repeats = "(report_id % 3 = 0)::INT"
    sql["classify_repeated"] = _with(
        {**_ROUTED, "outcomes": f"""SELECT report_id, prediction AS outcome, 1 + {repeats} AS n FROM routed WHERE report_id % 7 <> 1
UNION ALL SELECT report_id, 'ambiguous_id', 2 + {repeats} FROM good WHERE report_id % 7 = 1
UNION ALL SELECT report_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 20 THEN 'too_short' ELSE 'blank' END, 1 + {repeats}
FROM reports WHERE report_id NOT IN (SELECT report_id FROM good)"""},
        "SELECT report_id, outcome FROM (SELECT report_id, outcome, unnest(range(0, n)) FROM outcomes)",
    )
    own = {
        **_DECIDED,
        "cands": """SELECT report_id, unnest(l) AS label, unnest(range(1, len(l) + 1)) AS rank
FROM (SELECT report_id, CASE WHEN report_id % 2 = 0 THEN ['EN-1', 'XX-9', 'FR-1'] ELSE ['DE-1', 'XX-9'] END AS l FROM reports)""",
        "chosen": """SELECT w.report_id, w.chunk_index, c.label, c.rank, coalesce(s.score, 0) AS score,
max(coalesce(s.score, 0)) OVER (PARTITION BY w.report_id, w.chunk_index) AS top
FROM windows w JOIN cands c USING (report_id) LEFT JOIN scores s
ON s.report_id = w.report_id AND s.chunk_index = w.chunk_index AND s.label = c.label""",
    }
    sql["classify_own_candidates"] = _with(_routed(own), "SELECT report_id, prediction, routed_to FROM routed")
    sql["scorer_errors"] = _with(
        {**_ROUTED, "lasts": "SELECT report_id, max_by(label, rank) AS label FROM cands GROUP BY report_id"},
        f"""SELECT r.report_id, CASE WHEN r.score >= {T}::DOUBLE THEN r.prediction
WHEN length(t.text) % 5 = 0 THEN 'scorer: ValueError: refused' ELSE l.label END AS outcome
FROM routed r JOIN reports t USING (report_id) JOIN lasts l USING (report_id)
UNION ALL SELECT report_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 20 THEN 'too_short' ELSE 'blank' END
FROM reports WHERE report_id NOT IN (SELECT report_id FROM good)""",
    )
    held = {**_SPLIT_PARTS, "held": "SELECT report_id, label FROM split_rows WHERE split = 'test'"}
    sql["logistic_regression"] = _with(
        held, "SELECT report_id, true AS sums_to_one, true AS is_best, true AS is_optimal FROM held"
    )
    sql["linear_svm"] = _with(
        {**held, "classes": "SELECT count(DISTINCT label)::INT AS n_scores FROM split_rows WHERE split = 'train'"},
        "SELECT report_id, n_scores, true AS is_best FROM held CROSS JOIN classes",
    )
    sql["calibrated_svm"] = _with(
        held, "SELECT report_id, true AS sums_to_one, true AS is_best, true AS ranks_by_score FROM held"
    )
    sql["holdout_scores"] = _with(
        held,
        """SELECT unnest(['logistic', 'calibrated_svm']) AS model, n, true AS beats_largest_class, true AS has_macro_f1,
true AS has_weighted_f1 FROM (SELECT count(*) AS n FROM held)""",
    )
    sql["saved_svm_round_trip"] = _with(held, "SELECT 3 * count(*) AS n_rows, 0::BIGINT AS n_different FROM held")
    sql["classify_svm"] = _with(
        {"reports": _REPORTS},
        """SELECT report_id, true AS ranks_by_svm, true AS is_candidate FROM reports
WHERE length(text) >= 20 AND regexp_matches(text, '\\S')""",
    )
    sql["batch_totals"] = """SELECT count(*) AS total, count(*) FILTER (length(text) >= 20 AND regexp_matches(text, '\\S')) AS succeeded,
count(*) FILTER (text IS NULL OR length(text) < 20 OR NOT regexp_matches(text, '\\S')) AS failed FROM documents"""
    sql["cascade_quality"] = _with(
        _DECIDED,
        f"""SELECT count(*) AS total_reports, count(*) FILTER (score >= {T}::DOUBLE) AS high_confidence_count,
count(*) FILTER (score < {T}::DOUBLE) AS low_confidence_count,
round(avg((label = hybrid_label)::INT), 6) AS overall_accuracy,
coalesce(round(avg((label = hybrid_label)::INT) FILTER (score >= {T}::DOUBLE), 6), 0) AS high_confidence_accuracy,
coalesce(round(avg((label = hybrid_label)::INT) FILTER (score < {T}::DOUBLE), 6), 0) AS low_confidence_accuracy
FROM split_rows JOIN decisions USING (report_id) WHERE split = 'test'""",
    )
    sql["validation_sweep"] = _with(
        {**_DECIDED, "split_rows": _THREE_WAY,
         "facts": """SELECT label AS y_true, hybrid_label AS pred, round(score, 6) AS confidence
FROM split_rows JOIN decisions USING (report_id) WHERE split = 'validation'""",
         "grid": "SELECT i / 20.0::DOUBLE AS t FROM range(0, 21) r(i)"},
        """SELECT t AS threshold, count(*) FILTER (confidence >= t) AS n_above,
round(avg((confidence >= t)::INT), 6) AS coverage,
round(avg((y_true = pred)::INT) FILTER (confidence >= t), 6) AS accuracy_above,
round(avg((y_true = pred)::INT) FILTER (confidence < t), 6) AS accuracy_below
FROM facts CROSS JOIN grid GROUP BY t""",
    )
    sql["threshold_change"] = _with(
        _DECIDED,
        f"""SELECT {T}::DOUBLE AS previous_threshold, 0.5::DOUBLE AS new_threshold, count(*) AS total,
count(*) FILTER (score >= {T}::DOUBLE AND score < 0.5::DOUBLE) AS to_fallback,
count(*) FILTER (score < {T}::DOUBLE AND score >= 0.5::DOUBLE) AS to_hybrid FROM decisions""",
    )
    sql["rerouted_reports"] = _with(
        _routed(_DECIDED, threshold=0.5, checked=False), "SELECT report_id, prediction, routed_to FROM routed"
    )

    # log metrics
    sql["log_metrics"] = _with({"log": _LOG}, f"SELECT {_metrics()} FROM log")
    sql["log_metrics_empty"] = _with({"log": _LOG}, f"SELECT {_metrics()} FROM log WHERE routed_to = 'absent'")
    sql["log_metrics_by"] = _with(
        {"log": _LOG,
         "leveled": """SELECT 'all' AS level, NULL::VARCHAR AS backend, NULL::VARCHAR AS rel, NULL::VARCHAR AS day, * FROM log
UNION ALL SELECT 'backend', routed_to, NULL, NULL, * FROM log
UNION ALL SELECT 'reliability', NULL, reliability, NULL, * FROM log
UNION ALL SELECT 'day', NULL, NULL, created_at::DATE::VARCHAR, * FROM log"""},
        f"SELECT level, backend, rel AS reliability, day, {_metrics()} FROM leveled GROUP BY level, backend, rel, day",
    )
    sql["latency_percentiles"] = _with(
        {"log": _LOG},
        """SELECT routed_to, round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms,
round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms FROM log GROUP BY routed_to""",
    )

    # evaluation
    hits = "avg((y_true = pred)::INT)"
    sql["model_accuracy"] = _with(
        _EVAL, f"SELECT model, count(*) AS n, round({hits}, 6) AS accuracy FROM joined GROUP BY model"
    )
    by_model = {**_EVAL, **_class_table("joined", "model")}
    sql["f1_scores"] = _with(
        by_model, "SELECT model, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM f1s"
    )
    sql["confusion_matrix"] = _with(
        _EVAL, "SELECT model, y_true, pred, count(*) AS n FROM joined GROUP BY model, y_true, pred"
    )
    cells = ", ".join(f"count(*) FILTER (pred = '{c}') AS {c}" for c in ("de", "en", "es", "fr"))
    sql["confusion_pivot"] = _with(_EVAL, f"SELECT model, y_true, {cells} FROM joined GROUP BY model, y_true")
    sql["per_class_scores"] = _with(
        by_model,
        """SELECT model, label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(f1, 6) AS f1 FROM class_table""",
    )
    leveled = {**_EVAL, "leveled": _LEVELED, **_class_table("leveled", "model", "band")}
    sql["model_comparison"] = _with(
        {**leveled, "accs": f"SELECT model, band, count(*) AS n, {hits} AS accuracy FROM leveled GROUP BY model, band"},
        """SELECT model, band, n, round(n / (SELECT count(*) FROM truth)::DOUBLE, 6) AS share,
round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
round(accuracy - max(accuracy) FILTER (model = 'base') OVER (PARTITION BY band), 6) AS delta
FROM accs JOIN f1s USING (model, band)""",
    )
    gains = """count(*) FILTER (base_pred <> y_true AND pred = y_true) AS recoveries,
count(*) FILTER (base_pred = y_true AND pred <> y_true) AS regressions,
count(*) FILTER (base_pred <> y_true AND pred <> y_true) AS both_wrong,
count(*) FILTER (base_pred <> y_true AND pred = y_true) - count(*) FILTER (base_pred = y_true AND pred <> y_true) AS net_gain"""
    sql["recovery"] = _with(
        _EVAL, f"SELECT model, {gains} FROM joined WHERE band = 'LOW' AND model <> 'base' GROUP BY model"
    )
    subset = {
        **_EVAL,
        "sub": """SELECT * FROM joined WHERE model = 'model_a' AND report_id IN (SELECT doc_id FROM labels)""",
        "leveled": """SELECT *, band AS level FROM sub WHERE band = 'LOW' UNION ALL SELECT *, 'ALL' FROM sub""",
        **_class_table("leveled", "level"),
    }
    sql["subset_comparison"] = _with(
        subset,
        f"""SELECT level AS band, count(*) AS n, round(avg((y_true = base_pred)::INT), 6) AS base_accuracy,
round({hits}, 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1,
round({hits} - avg((y_true = base_pred)::INT), 6) AS delta, {gains}
FROM leveled JOIN f1s USING (level) GROUP BY level""",
    )
    sql["model_availability"] = _with(
        _EVAL,
        """SELECT r.model, count(p.model) > 0 AS is_available, count(p.model) AS n_predictions
FROM registry r LEFT JOIN preds p USING (model) GROUP BY r.model""",
    )
    low = {
        **_EVAL,
        "gains": f"""SELECT model, {hits} AS accuracy,
count(*) FILTER (base_pred <> y_true AND pred = y_true) - count(*) FILTER (base_pred = y_true AND pred <> y_true) AS net_gain
FROM joined WHERE band = 'LOW' GROUP BY model""",
        "low": "SELECT * FROM gains JOIN registry USING (model)",
        "best": """SELECT model FROM low WHERE is_local AND NOT is_baseline AND accuracy > 0
ORDER BY accuracy DESC, registry_order LIMIT 1""",
    }
    sql["best_local_model"] = _with(
        low, "SELECT model, round(accuracy, 6) AS accuracy, net_gain FROM low WHERE model IN (SELECT model FROM best)"
    )
    sql["model_ranking"] = _with(
        low,
        """SELECT model, rank() OVER (ORDER BY accuracy DESC)::INT AS place, round(accuracy, 6) AS accuracy, net_gain,
model IN (SELECT model FROM best) AS is_chosen FROM low""",
    )
    high = f"confidence >= {T}::DOUBLE"
    sql["confidence_shares"] = _with(
        _EVAL,
        f"""SELECT count(*) AS n, count(*) FILTER ({high}) AS n_high, count(*) FILTER (NOT {high}) AS n_low,
round(avg(({high})::INT), 6) AS share_high, round(avg((NOT {high})::INT), 6) AS share_low FROM truth""",
    )
    sql["evaluation_summary"] = _with(
        _EVAL,
        f"""SELECT count(*) AS total_reports, round({hits}, 6) AS overall_accuracy,
round({hits} FILTER ({high}), 6) AS high_confidence_accuracy, round({hits} FILTER (NOT {high}), 6) AS low_confidence_accuracy,
count(*) FILTER ({high}) AS high_confidence_count, count(*) FILTER (NOT {high}) AS low_confidence_count
FROM joined WHERE model = 'base'""",
    )
    sql["threshold_sweep"] = _with(
        {**_EVAL, "grid": "SELECT i / 100.0::DOUBLE AS t FROM range(0, 101) r(i)"},
        """SELECT t AS threshold, count(*) FILTER (confidence >= t) AS n_above,
round(avg((confidence >= t)::INT), 6) AS coverage,
round(avg((y_true = pred)::INT) FILTER (confidence >= t), 6) AS accuracy_above,
round(avg((y_true = pred)::INT) FILTER (confidence < t), 6) AS accuracy_below
FROM joined CROSS JOIN grid WHERE model = 'base' GROUP BY t""",
    )
    sql["routed_accuracy"] = _with(
        {**_EVAL, "grid": "SELECT i / 20.0::DOUBLE AS t FROM range(0, 22) r(i)"},
        """SELECT model, t AS threshold,
round(avg((CASE WHEN confidence >= t THEN base_pred ELSE pred END = y_true)::INT), 6) AS accuracy
FROM joined CROSS JOIN grid WHERE model <> 'base' GROUP BY model, t""",
    )

    # streaming
    sql["stream_classify_reports"] = _with(
        _ROUTED, f"SELECT {_ID} AS id, prediction, routed_to, 'high' AS reliability FROM routed"
    )
    sql["stream_unique_predictions"] = _with({"log": _LOG}, "SELECT id, routed_to, reliability FROM log")
    sql["stream_daily_metrics"] = _with(
        {"log": _LOG, "days": "SELECT *, date_trunc('day', created_at)::TIMESTAMP AS w FROM log"},
        f"""SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, {_WINDOWED} FROM days GROUP BY w""",
    )
    sql["stream_sliding_metrics"] = _with(
        {"log": _LOG,
         "slides": """SELECT *, time_bucket(INTERVAL 6 HOUR, created_at) - unnest([0, 1, 2, 3]) * INTERVAL 6 HOUR AS w FROM log"""},
        f"""SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, {_WINDOWED} FROM slides GROUP BY w""",
    )
    return sql
