"""The pipeline's stages and result on the small tables."""

import __spark_entry__ as E
import corpus_pipeline
from cargolake.llm import decontaminate, langid, simhash

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = docs.limit(1).selectExpr("999999L doc_id", "'1 2 3' text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in kept.collect()}
        assert after <= before
        if name == "language_id":
            assert before - after == {999999}
        if name == "simhash_dedup":
            assert after == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert before - after == {r.doc_id for r in decontaminate.contaminations(docs, items).collect()}
        docs = kept
    packed = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert langid.UNKNOWN == "und"


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
