import zlib

import pytest
from oracle import compare

import corpus_pipeline
from sketchloom.llm.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    compare(QUERIES[name](spark, D), ORACLES[name], D)


def test_op7(spark):
    got = QUERIES["op7_quality_classifier"](spark, D).toPandas()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    y = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "quality").toPandas()
    m = got[got.held_out].merge(y, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.9


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.run(spark, D)
    first = out.filter("sample = 1")
    assert out.filter("NOT lossless").count() == 0
    assert 0.5 * docs.count() < first.count() < docs.count()
    assert len(corpus_pipeline.STAGES) == 5
