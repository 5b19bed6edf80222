"""The pipeline against the operators' brute-force meaning on the smallest tables."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as P
    from plumbline.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    before = set(texts)
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.8 * len(before)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "exact_dedup":
            norm = [" ".join(texts[i].split()) for i in after]
            assert len(set(norm)) == len(norm)
        before = after
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(t in texts[i] for i in before for t in items)
