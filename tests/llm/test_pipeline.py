import corpus_pipeline

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = list(entry.queries())
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}) == list(range(1, 14))
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_stages_agree_with_their_queries(spark):
    """Each stage drops what its operator's query names on the same rows, and nothing else."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    clean = stages[0](spark, docs, SMALL)
    toxic = {r.doc_id for r in entry.queries()["op8_toxicity"](spark, SMALL).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    single = stages[1](spark, docs, SMALL)
    kept = {r.doc_id for r in entry.queries()["op10_exact_dedup"](spark, SMALL).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == kept
    apart = stages[2](spark, docs, SMALL)
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in entry.queries()["op2_ngram_jaccard"](spark, SMALL).collect()}
    assert all(x.columns == docs.columns for x in (clean, single, apart))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
