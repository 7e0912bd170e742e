"""Pipeline stages on tables whose other columns have the operators' names."""
import corpus_pipeline
from scorelake.llm import exact_dedup, mixing, sentencepiece_fst
from scorelake.llm.common import table

SF = "/root/testdata/sf0.001"
EXTRA = ["key", "row", "size", "_size", "_key", "part", "copy", "more", "tie", "repeats", "c0", "_ids", "salt", "sha", "rep", "kept", "0", "a b", "x", "block", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in EXTRA)


def corpus(spark):
    rows = [(1, "Some plain words, and more of them in a row.", "en", "a", 3), (1, "Some plain words, and more of them in a row.", "en", "a", 3), (2, "SOME plain words, and more of them in a row.", "en", "a", 3),
            (3, None, None, None, None), (4, "", "en", "b", 0), (5, "a long text of very many words " * 30_000, "en", "b", 1), (None, "no id at all", "en", "b", 2)]
    return spark.createDataFrame([(*r, *[f"{c}:{r[0]}" for c in EXTRA]) for r in rows], SCHEMA)


def extras_kept(got):
    return all(r[c] == f"{c}:{r.doc_id}" for r in got for c in EXTRA)


def test_every_stage_keeps_clashing_columns(spark):
    docs = corpus(spark)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns[: len(docs.columns)] == docs.columns
        assert extras_kept(got.collect())


def test_dedup_of_ties_and_repeated_rows(spark):
    got = exact_dedup.keep_last_copies(corpus(spark)).collect()
    assert extras_kept(got) and sorted(str(r.doc_id) for r in got) == ["2", "4", "5", "None"]


def test_mix_and_ids_beside_clashing_columns(spark):
    docs = corpus(spark)
    mixed = mixing.mixed_documents(docs).collect()
    assert extras_kept(mixed) and all(r.text for r in mixed)
    coded = sentencepiece_fst.encode(docs, out_col="ids").collect()
    assert len(coded) == docs.count() and extras_kept(coded) and all((not r.text) == (len(r.ids) == 0) for r in coded)
    again = sentencepiece_fst.encode(docs, out_col="salt")
    assert again.columns.count("salt") == 1 and again.columns[-1] == "salt"


def test_memories_are_bounded_and_emptied():
    fst = sentencepiece_fst.transducer(sentencepiece_fst.default_model())
    small, sentencepiece_fst.MEMORY = sentencepiece_fst.MEMORY, 1 << 16
    try:
        words = [f"w{i}x{i % 7}" for i in range(3000)]
        first = [list(fst.encode(w)) for w in words]
        assert (len(fst._seen) + len(fst._old_seen)) * sentencepiece_fst._ENTRY <= 1 << 16
        assert (len(fst._pair) + len(fst._old_pair)) * sentencepiece_fst._PAIR <= (1 << 16) + 400
    finally:
        sentencepiece_fst.MEMORY = small
    assert [list(fst.encode(w)) for w in words] == first
    fst.forget()
    assert not (fst._seen or fst._pair or fst._old_seen or fst._old_pair)
