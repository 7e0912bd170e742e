"""The pipeline's last stage marks texts that decoding doesn't give back."""

import corpus_pipeline
from scorelake.llm import sentencepiece_fst as S


def test_pipeline_marks_texts_that_do_not_survive(spark):
    rows = [(1, "plain words, é and 你"), (2, "a ▁ block"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    want = {r.doc_id: r for r in S.round_trip(docs).collect()}
    assert {i: (r.ids, r.n_ids, r.same) for i, r in got.items()} == {i: (r.ids, r.n_ids, r.same) for i, r in want.items()}
    assert got[1].same and not got[2].same and S.encode(docs).columns == ["doc_id", "text", "ids"]
