import corpus_pipeline
from tests.llm.test_exact_dedup import brute as equal
from tests.llm.test_ngram_join import brute as similar

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, quality), (_, exact), (_, near), (_, pack) = corpus_pipeline.STAGES
    good = quality(spark, docs, SF)
    assert good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert 100 < len(rows) < docs.count()
    unique = exact(spark, good, SF)
    ids = {r.doc_id for r in unique.collect()}
    assert unique.columns == docs.columns and ids == {d for d, v in equal(rows).items() if v[2]}
    rows = [r for r in rows if r[0] in ids]
    last = near(spark, unique, SF)
    ids = {r.doc_id for r in last.collect()}
    assert last.columns == docs.columns and ids == {c for _, _, c in similar(rows, 5, 80)}
    assert {r.doc_id for r in pack(spark, last, SF).collect()} == ids


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50
