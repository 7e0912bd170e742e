import re
from collections import Counter, defaultdict

import sentencepiece

import corpus_pipeline
from scorelake.llm import sentencepiece_fst
from scorelake.llm.common import table
from test_mixing import fill
from test_near_join import brute

SF = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").encode().lower()


def test_stages_against_plain_versions(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept, lib = docs.columns, [], sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "source mix", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[: len(columns)] == columns and (k == 4 or out.columns == columns)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    first = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}

    good = {r.doc_id: r.text for r in kept[0]}
    assert all(first[i] == t for i, t in good.items()) and len(good) == len(kept[0])
    assert sum(i in good for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    assert sum(i not in good for i, q in labels.items() if q == 0) >= 0.9 * sum(q == 0 for q in labels.values())

    last = defaultdict(int)
    for i, t in good.items():
        last[low(t)] = max(last[low(t)], i)
    assert sorted(r.doc_id for r in kept[1]) == sorted(last.values())

    component, _ = brute([(r.doc_id, r.text) for r in kept[1]], 5, 8, 10)
    assert sorted(r.doc_id for r in kept[2]) == sorted(set(component.values()))

    sizes, taken, texts = Counter(), Counter(), {r.doc_id: r for r in kept[2]}
    for r in kept[2]:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    for r in kept[3]:
        assert (texts[r.doc_id].text or "").startswith(r.text) and texts[r.doc_id].source == r.source
        taken[r.source] += len(WORDS.findall(r.text))
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)

    mixed = Counter((r.doc_id, r.text) for r in kept[3])
    assert Counter((r.doc_id, r.text) for r in kept[4]) == mixed
    assert all(list(r.ids) == lib.encode(r.text) and r.n_ids == len(r.ids) for r in kept[4])

    ran = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.text) for r in ran.select("doc_id", "text").collect()) == mixed


def test_stages_on_nulls_and_empty_tables(spark):
    schema = table(spark, SF, "documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "Some plain words.", None, None, 3)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        got = stage(spark, odd, SF)
        assert got.columns[:5] == odd.columns and got.count() <= 5 + 2
