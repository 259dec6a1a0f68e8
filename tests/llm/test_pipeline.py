import pytest
from tests.llm.util import words
from tests.test_workload import same

from skarn.llm.queries import ORACLES, QUERIES
from skarn.llm.session import table

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    same(spark, sf, name, QUERIES[name], ORACLES[name])


def test_stages_hand_on_the_columns_of_documents(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, left = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == columns and 0 < after.count() <= left
            left = after.count()
            docs = after
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == ids
    items = [words(r.text) for r in table(spark, sf, "benchmark").collect()]
    for r in docs.collect():
        t = " ".join(words(r.text))
        assert not any(" ".join(w) in t for w in items if len(w) >= 15)


def test_run(spark, sf):
    assert pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
