from __future__ import annotations

import pytest

import corpus_pipeline
from specloom.llm import pii, quality, queries, simhash, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_by_a_plain_version(spark, tmp_path):
    """Each stage against a selection in plain Python from the operators' verdicts on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns
        if name == "quality":
            want = {r["doc_id"] for r in quality.quality_verdicts(docs).collect() if r["kept"]}
        elif name == "toxicity":
            want = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if not r["predicted"]}
        elif name == "simhash":
            want = {r["component_id"] for r in simhash.simhash_components(docs).collect()}
        else:
            want = set(before)
        assert {r["doc_id"] for r in rows} == want
        if name == "pii":
            field = pii.train()
            for r in rows:
                text = before[r["doc_id"]]["text"]
                assert r["text"] == pii.redacted(text, pii.spans_of([text], field)[0][1]) and r["n_chars"] == len(r["text"])
        elif name != "packing":
            assert all(r == before[r["doc_id"]] for r in rows)
        docs = after
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


@pytest.mark.parametrize("name", ["quality", "toxicity", "simhash", "pii", "packing"])
def test_stages_take_odd_and_empty_tables(spark, odd_documents, no_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd_documents, SMALL).count() > 0
    assert stage(spark, no_documents, SMALL).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_results_of_stages_can_be_read_later(spark, tmp_path):
    """A stage leaves alone what another stage's unread result needs, and a run what another run's result needs."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = corpus_pipeline.quality_stage(spark, docs, SMALL)
    b = corpus_pipeline.packing_stage(spark, docs, SMALL)
    first = corpus_pipeline.run(spark, SMALL)
    second = corpus_pipeline.run(spark, SMALL)
    assert 0 < a.count() < docs.count() and b.select("doc_id").distinct().count() == docs.count()
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
