import corpus_pipeline
from kindred.llm import queries


def test_stages_and_entry(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for (name, stage), n in zip(corpus_pipeline.STAGES, (1, 6, 9, 3, 10)):
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{n}")
        if n != 10:
            assert docs.columns == names, name
            assert docs.count() > 0
        if n == 9:
            assert docs.count() == before.count()
    texts = {(r.doc_id, r.text) for r in before.collect()}
    assert all(r.decoded and r.ids is not None for r in docs.collect())
    assert {i for i, _ in texts} == {r.doc_id for r in docs.collect()}
    found = entry.queries()
    assert "pipeline" in found and set(queries.QUERIES) <= set(found)
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))
