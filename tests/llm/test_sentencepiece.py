import itertools
import math

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import sentencepiece_fst as S

LIB = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
FST = S.transducer(S.default_model())
WORDS = ["the", "ing", " ", "  ", "   ", "\n", "\t", "é", "ß", "你", "好", "🙂", "a", "b", "aa", "1", "23", ".", "...", "tion", "▁", "​", "\x00", "İ", "x" * 40, "é"]


def same(text):
    ids = FST.encode(text).tolist()
    assert ids == LIB.encode(text), repr(text)
    if "▁" not in text:
        assert FST.decode(ids) == text


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(WORDS), max_size=25).map("".join)))
def test_ids_equal_the_library(text):
    same(text)


def test_corpus_texts_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = S.round_trip(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.ids) == LIB.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.same


def test_unigram_takes_the_lightest_path():
    vocab = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -6.0, "aba": -4.9, "bb": -4.1, S.SPACE: -3.0, S.SPACE + "a": -3.2}
    fst = S.Transducer([("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(p, w, 1) for p, w in vocab.items()], bpe=False)

    def brute(text):
        best = (math.inf, None)
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            if all(p in vocab or (len(p) == 1) for p in parts):
                w = sum(-vocab[p] if p in vocab else S.UNKNOWN_PENALTY - fst.least for p in parts)
                best = min(best, (w, parts), key=lambda x: x[0])
        return best[0]

    for n in range(1, 8):
        for t in itertools.product("ab c", repeat=n):
            text = "".join(t)
            ids = fst.encode(text).tolist()
            norm = fst.normalise(text)
            got = sum(-fst.score[i] if fst.text[i] in vocab else S.UNKNOWN_PENALTY - fst.least for i in ids)
            assert abs(got - brute(norm)) < 1e-9 and fst.decode(ids) == text


def test_edges(spark):
    rows = [(1, None, [1], "k"), (2, "", [], None), (3, "word " * 200_000, None, ""), (None, "a", [2], ""), (4, "x" * 300_000, None, ""), (4, "x" * 300_000, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, _x string")
    got = {str(r.doc_id): r for r in S.round_trip(df).collect()}
    assert got["1"].n_ids == got["2"].n_ids == 0 and all(r.same for r in got.values())
    assert list(got["3"].ids) == LIB.encode(rows[2][1])
    enc = S.encode(df)
    assert sorted(enc.columns) == sorted(df.columns) and enc.count() == 6
    back = S.decode(enc.select("doc_id", "ids")).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert S.round_trip(df.limit(0)).count() == 0 and S.encode(df.limit(0)).count() == 0
