"""The pipeline on the smallest tables and on odd rows."""

import corpus_pipeline
from groundspan.llm import simhash
from groundspan.llm.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "SentencePiece" and len(corpus_pipeline.STAGES) == 5
    docs = table(spark, sf, "documents")
    copies = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert kept.columns == COLUMNS
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in copies.items() if i == c)
    clean = corpus_pipeline.decontaminated(spark, docs, sf)
    assert clean.columns == COLUMNS and 0 < clean.count() < docs.count()
    done = corpus_pipeline.run(spark, sf)
    assert done.columns == [*COLUMNS, "ids", "n_tokens", "round_trip"]
    assert 0 < done.count() <= clean.count() and done.where("not round_trip").count() == 0


def test_near_dedup_odd_rows(spark, sf):
    text = "some words that stand in this text more than once"
    rows = [(5, text), (5, text), (6, text), (7, "other words altogether are in here now"), (None, text), (None, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [5, 7, 8, None, None]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), sf).count() == 0
