import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_keep_their_columns_and_equal_run(spark, tmp_path):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    again = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))
