"""The pipeline's stages take effect, keep what is clean and pass all of it on."""

import corpus_pipeline
from reviewlake.llm.queries import QUERIES


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.count())
    assert kept[0] >= kept[1] > kept[2] >= kept[3] > 0
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
