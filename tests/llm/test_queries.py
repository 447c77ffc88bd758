"""The eleven queries over whole small tables, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import (
    all_spans,
    base_spans,
    components,
    contained,
    crc,
    fingerprint,
    groups,
    spans_text,
    substring,
)
from sluice.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


def rows_of(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_substring_dedup(spark, sf, docs):
    got = rows_of(spark, sf, "op1_substring_dedup")
    assert sorted(map(tuple, got)) == sorted(substring(docs))


def test_token_files(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = [e.ids + [1] for e in library.encode_batch([t for _, t in docs], add_special_tokens=False)]
    starts = np.cumsum([0] + [len(e) for e in encoded])
    want = [(d, int(s), len(e), crc(e)) for (d, _), s, e in zip(docs, starts, encoded)]
    assert sorted(map(tuple, rows_of(spark, sf, "op2_token_files"))) == want


def test_sharding(spark, sf, docs):
    got = rows_of(spark, sf, "op3_sharding")
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [
        (d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in docs
    ]
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [0] for d, t in docs}
    got = rows_of(spark, sf, "op4_best_fit_packing")
    places, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        places[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, all_ids in ids.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(places[d])):
            assert (piece, start) == (k, at) and (k == 0 or length == 2048)
            at += length
        assert at == len(all_ids) and (len(all_ids) > 2048) == (len(places[d]) > 1)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert len(sequences) <= 1.03 * least + 1


def test_token_counts(spark, sf, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = [len(i) for i in model.encode([t for _, t in docs], num_threads=1)]
    want = [(d, len(t.encode()), k, k > 4096) for (d, t), k in zip(docs, n)]
    assert sorted(map(tuple, rows_of(spark, sf, "op5_token_counts"))) == want


def test_exact_dedup(spark, sf, docs):
    want = [
        (i, max(ids), len(ids), i == max(ids), digest)
        for digest, ids in groups(docs).items()
        for i in ids
    ]
    assert sorted(map(tuple, rows_of(spark, sf, "op6_exact_dedup"))) == sorted(want)


def test_quality_classifier(spark, sf, docs):
    got = rows_of(spark, "/root/testdata/sf0.01", "op7_quality_classifier")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    scores = {r.doc_id: r for r in got}
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(scores[r.doc_id].score, r.quality) for r in labels if scores[r.doc_id].held_out]
    good = [s for s, q in held if q == 1]
    bad = [s for s, q in held if q == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9


def test_simhash(spark, sf, docs):
    fps = {d: fingerprint(t) for d, t in docs}
    comp = components(fps)
    want = [(d, f"{fps[d]:016x}", comp[d]) for d, _ in docs]
    assert sorted(map(tuple, rows_of(spark, sf, "op8_simhash_near_dedup"))) == want


def test_secrets(spark, sf, docs):
    got = {r.doc_id: r for r in rows_of(spark, sf, "op9_secret_scan")}
    for d, t in docs:
        base, r = base_spans(t), got[d]
        kinds = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        assert r.base_sha256 == hashlib.sha256(spans_text(base).encode()).hexdigest()
        assert r.spans == spans_text(all_spans(t))


def test_decontamination(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(spark, sf, "op10_benchmark_decontamination")
    assert sorted((r.doc_id, r.item_id, r.matched, r.item_shingles) for r in got) == sorted(contained(docs, items))
