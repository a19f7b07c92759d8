import corpus_pipeline
from docquarry.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        seen.append((name, docs.count()))
        if name != "encoding":
            assert docs.columns == columns
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids))
        if name == "pii":
            assert all(not pii.base_spans(r.text) for r in docs.select("text").collect())
    assert [n for n, _ in seen] == ["quality", "near_duplicates", "pii", "mixing", "encoding"]
    counts = dict(seen)
    assert 0 < counts["near_duplicates"] <= counts["quality"] <= spark.read.parquet(f"{SF}/documents.parquet").count()
    assert counts["encoding"] == counts["mixing"] > 0
    assert docs.where("n_tokens <> size(ids)").count() == 0
