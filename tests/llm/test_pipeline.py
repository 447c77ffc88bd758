"""The pipeline, stage by stage, against brute force on its own input."""

import corpus_pipeline
import pytest
from brute import components, contained, fingerprint, groups
from sluice.llm import quality
from sluice.llm.common import stage


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        tables.append(stage(spark, f"t{k}", function(spark, tables[-1], sf)))
    return tables


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_documents_keep_their_columns(steps):
    for table in steps[:5]:
        assert table.columns == steps[0].columns
    assert set(steps[5].columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_quality_decides_by_score(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality as label")
    stats = quality.text_statistics(steps[0])
    scored = quality.scored(stats, quality.fit(stats, labels)).filter("predicted = 1")
    assert sorted(r.doc_id for r in scored.collect()) == sorted(i for i, _ in rows_of(steps[1]))


def test_one_copy_stays(steps):
    want = sorted(max(ids) for ids in groups(rows_of(steps[1])).values())
    assert sorted(i for i, _ in rows_of(steps[2])) == want


def test_one_near_copy_stays(steps):
    comp = components({i: fingerprint(t) for i, t in rows_of(steps[2])})
    assert sorted(i for i, _ in rows_of(steps[3])) == sorted(i for i in comp if comp[i] == i)


def test_contaminated_documents_go(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = rows_of(steps[3])
    leaked = {d for d, *_ in contained(before, items)}
    assert sorted(i for i, _ in rows_of(steps[4])) == sorted(i for i, _ in before if i not in leaked)


def test_every_document_is_packed(spark, sf, steps):
    ids = {r.doc_id for r in steps[5].collect()}
    assert ids == {i for i, _ in rows_of(steps[4])}
    run = corpus_pipeline.run(spark, sf)
    assert run.count() == steps[5].count() and run.columns == steps[5].columns
