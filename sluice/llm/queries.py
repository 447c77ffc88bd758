"""One query per operator, over its whole table, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import quality
from sluice.llm.decontaminate import contained_items
from sluice.llm.exact_dedup import decisions
from sluice.llm.hard_negatives import hard_negatives
from sluice.llm.lloyd import clustered
from sluice.llm.minhash import near_duplicates as minhash_duplicates
from sluice.llm.packing import packed_documents
from sluice.llm.secrets import as_text, count_of, secret_spans
from sluice.llm.sharding import sharded
from sluice.llm.simhash import near_duplicates
from sluice.llm.substring_dedup import removed_windows
from sluice.llm.token_counts import token_counts
from sluice.llm.token_files import read_tokens, write_tokens
from sluice.llm.tokens import vocabulary_size
from sluice.session import StageStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# DuckDB: the words of a text, [^\x20\x09-\x0D]+.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query
def op1_substring_dedup(spark, sf_dir):
    done = removed_windows(documents(spark, sf_dir))
    return done.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLES["op1_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM x JOIN f USING (h) WHERE doc_id > least),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
sha256(array_to_string(list_filter(w, lambda v, k: NOT list_contains(coalesce(gone, []), k)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@query
def op6_exact_dedup(spark, sf_dir):
    return decisions(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLES["op6_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@query
def op10_benchmark_decontamination(spark, sf_dir):
    return contained_items(documents(spark, sf_dir), benchmark(spark, sf_dir))


_SHINGLES = """SELECT DISTINCT {id}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) > 0)"""
ORACLES["op10_benchmark_decontamination"] = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS matched FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, matched, item_shingles, matched / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE matched >= 0.8 * item_shingles"""


@query
def op8_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op2_token_files(spark, sf_dir):
    path = StageStore(spark).path("token_files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(documents(spark, sf_dir), path, tokenizer, vocabulary_size(tokenizer), end_id=1)
    return read_tokens(spark, path)


@query
def op3_sharding(spark, sf_dir):
    """The law `key`, over 40 shards of equal weight."""
    text = F.coalesce("text", F.lit(""))
    records = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharded(records, "doc_id", [1.0] * 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op4_best_fit_packing(spark, sf_dir):
    return packed_documents(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )


@query
def op5_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col("quality").alias("label")
    )


@query
def op7_quality_classifier(spark, sf_dir):
    stats = quality.text_statistics(documents(spark, sf_dir))
    return quality.scored(stats, quality.fit(stats, quality_labels(spark, sf_dir)))


@query
def op9_secret_scan(spark, sf_dir):
    return secret_spans(documents(spark, sf_dir)).select(
        "doc_id",
        *[count_of("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(as_text("base"), 256).alias("base_sha256"),
        as_text("spans").alias("spans"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


# DuckDB: vectors without null or non-finite components, as integers.
_GRID = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
FROM embeddings WHERE embedding IS NOT NULL
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query
def op11_centroid_clustering(spark, sf_dir):
    return clustered(embeddings(spark, sf_dir))


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round: nearest centroids, then floored means; empty ones stay."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, min({{'d': list_sum(list_transform(list_zip(q, c),
lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': cluster}}) AS m FROM v, c{r} GROUP BY vec_id)"""
    moved = """u{r} AS MATERIALIZED (SELECT m.c AS cluster, j, sum(q[j])::BIGINT AS s, count(*) AS n
FROM v JOIN a{r} USING (vec_id), range(1, 65) t(j) GROUP BY ALL),
c{n} AS MATERIALIZED (SELECT cluster, coalesce(f, c) AS c FROM c{r} LEFT JOIN (SELECT cluster,
list((s - ((s % n) + n) % n) // n ORDER BY j) AS f FROM u{r} GROUP BY cluster) USING (cluster))"""
    steps = [
        f"v AS MATERIALIZED (SELECT * FROM ({_GRID}) WHERE len(q) = 64)",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q AS c FROM
(SELECT q, sha256('2:' || vec_id) AS h FROM v ORDER BY h, q LIMIT {k}))""",
    ]
    for r in range(rounds):
        steps += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    steps.append(nearest.format(r=rounds))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.c::INT AS cluster, m.d AS distance,
(sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON cluster = m.c"""


ORACLES["op11_centroid_clustering"] = _lloyd_sql()


@query
def op12_minhash_near_dedup(spark, sf_dir):
    return minhash_duplicates(documents(spark, sf_dir))


ORACLES["op12_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o) AS component_id, doc_id = min(o) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n"""


@query
def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings(spark, sf_dir).withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q
FROM ({_GRID}) WHERE label IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score,
score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
