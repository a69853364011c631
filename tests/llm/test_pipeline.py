"""The pipeline's stages keep their contracts on the smallest table."""

import corpus_pipeline
from trajectree.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids and out.count()
        if k < 4:
            assert out.columns == columns
        if name == "simhash_near_dedup":
            again = simhash.near_duplicates(out, corpus_pipeline.NEAR_COPY_RADIUS)
            assert again.filter("doc_id <> component_id").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()
