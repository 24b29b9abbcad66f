"""The pipeline's stages take effect and keep the columns of documents."""

import pytest

pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
    assert counts[1] < counts[0] and counts[3] < counts[2] and counts[5] == counts[4]
    assert docs.filter("text <> decoded or n_tokens <> size(ids)").count() == 0
