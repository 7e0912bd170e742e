import zlib

import numpy as np
import pytest

from scorelake.llm import language as L
from scorelake.llm import quality as Q
from scorelake.llm.common import word_hashes

SF = "/root/testdata/sf0.01"


def offsets(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def test_word_hashes_follow_the_words():
    texts = ["", "a b  a", "ab", " ", "a", "xé y z\x0bq", ""]
    h, b = word_hashes(*offsets(texts))
    words = [w for t in texts for w in t.replace("\x0b", " ").split(" ") if w]
    assert len(h) == len(words) and list(np.diff(b)) == [0, 3, 1, 0, 1, 3, 0]
    assert len(set(zip(words, h))) == len(set(words)) == len(set(h))


def test_statistics_do_not_depend_on_neighbours():
    texts = ["The end. The end.\nThe end. The end.", "", "A | b | c !!", "é" * 50, "one two three four\nfive"]
    x = Q.statistics(*offsets(texts))
    assert x.shape == (5, len(Q.FEATURES)) and np.isfinite(x).all()
    for i, t in enumerate(texts):
        assert np.allclose(Q.statistics(*offsets([t]))[0], x[i])


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.score_all(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    pairs = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in pairs if q == 1], [s for s, q in pairs if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_held_out_labels_and_inputs_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    a = {r.doc_id: r.score for r in Q.score_all(docs, labels).collect()}
    b = {r.doc_id: r.score for r in Q.score_all(docs.selectExpr("doc_id", "text", "'x' as lang", "0 as x"), flipped).collect()}
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "", 2.0), (None, "word " * 300_000, None)], "doc_id long, text string, x double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score_all(docs, none).collect()] == [0.5] * 4
    assert Q.score_all(docs.limit(0), none).count() == 0
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    held = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values()) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end as lang", "1 as gram")
    assert {(r.doc_id, r.lang_pred, r.score) for r in L.language_id(other).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in got.values()}


def test_grams_against_plain_python():
    texts = ["CafÉ au lait!", "", "a", "ab12cd", "Été"]
    g, who = L.grams(*offsets(texts))
    for i, t in enumerate(texts):
        low = "".join(c if c.isalpha() else " " for c in t.lower()).encode()
        s = b" " + low + b" "
        want = [s[k: k + 4] for k in range(len(s) - 3) if 32 not in s[k + 1: k + 3]]
        assert [int(x).to_bytes(4, "little") for x in g[who == i]] == want


def test_bloom_holds_every_member_and_many_languages(spark):
    rows = [(i, f"l{i % 40:02d}", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{w}x" for w in "abcdefgh")) for i in range(400)]
    rows += [(500, None, "abc"), (501, "l00", None), (502, "l00", "")]
    f = L.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(f.langs) == 40 and len(f.masks) == 2
    _, lang, text = rows[35]
    e = f.evidence(*offsets([text, ""]))
    assert e[0, f.langs.index(lang)] == e[0].max() > 0 and e[1].sum() == 0


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "你好", None), (None, "hello there", "en"), (5, "hello there", "en"),
                                (5, "hello there", "en")], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in L.language_id(df).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en"), (None, "en"), (4, "en")} == got
    assert L.language_id(df.where("false")).count() == 0
    assert {r.lang_pred for r in L.language_id(df.withColumn("lang", df.lang.substr(9, 1)).where("doc_id = 4")).collect()} == {"und"}
