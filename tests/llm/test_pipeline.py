import corpus_pipeline
from tickloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids and len(kept) > 0.8 * len(ids), name
    placed = corpus_pipeline.run(spark, SF)
    rows = placed.collect()
    assert {"doc_id", "sequence_id", "offset"} <= set(placed.columns) and {r.doc_id for r in rows} <= ids


def test_stages_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_registry():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(ORACLES) <= set(QUERIES)
