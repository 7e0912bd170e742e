import hashlib
import random

import numpy as np
import pytest

from scorelake.llm import repeats as R

SCHEMA = "doc_id long, text string, digest string, salt int, place int"


def brute(rows):
    """(doc_id, text) rows: {(doc_id, n_bytes, n_removed, n_spans, sha)}, from a table of all windows."""
    first = {}
    for i, t in rows:
        b, k = (t or "").encode(), R.LAST if i is None else i
        for s in range(len(b) - R.SPAN + 1):
            w = b[s: s + R.SPAN]
            first[w] = min(first.get(w, k), k)
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), R.LAST if i is None else i
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - R.SPAN + 1):
            if first[b[s: s + R.SPAN]] < k:
                cover[s: s + R.SPAN] = True
        spans = int(cover[:1].sum()) + int((cover[1:] & ~cover[:-1]).sum())
        out.append((str(i), len(b), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return sorted(out)


def check(spark, rows, parts=5):
    got = R.remove_repeats(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).repartition(parts)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    return got


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["the", "of", "ré", "你", "tion", "x", "\n"] + [f"w{i}" for i in range(300)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [line(rng.randint(5, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [line(rng.randint(0, 60)) for _ in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        if rows and rng.random() < 0.3:
            old = rng.choice(rows)[1]
            a = rng.randint(0, len(old))
            parts.append(old[a: a + rng.randint(0, 200)])
        if rows and rng.random() < 0.1:
            parts = [rng.choice(rows)[1]]
        rows.append((rng.choice([7 * i + 3, 2000 - i]), rng.choice(["", " "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_table_of_all_windows(spark, seed):
    got = check(spark, corpus(seed))
    assert sum(r.n_removed > 0 for r in got) > 20


def test_hot_minimizers_and_small_pieces(spark, monkeypatch):
    import scorelake.llm.repeats as module

    rows = corpus(9, 60)
    hot = "All of this passage is in very many documents, more than fifty bytes. "
    rows += [(5000 + i, f"{i} start {hot} end {i * 7919}" + "ab" * (i % 40)) for i in range(60)]
    labels = R.bucket_labels(spark, 8)
    monkeypatch.setattr(module, "HOT", 10)
    blocks = spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).select("doc_id", "text").coalesce(1)
    minimizers = blocks.mapInArrow(R._list_minimizers(labels), R.BLOCKS).toArrow()
    import pyarrow as pa
    found = [R._unpack(x)[3] for b in R._find_shared(labels)(iter(minimizers.to_batches())) for x in b.column("payload").to_pylist()]
    assert np.concatenate(found).any() and not np.concatenate(found).all()
    # the stages one after the other, in this process
    shared = pa.Table.from_batches([b for lab in set(minimizers["label"].to_pylist()) for b in R._find_shared(labels)(iter(minimizers.filter(pa.compute.equal(minimizers["label"], lab)).to_batches()))])
    firsts = {}
    for i, t in rows:
        d = R._digest((t or "").encode())
        firsts[d] = min(firsts.get(d, R.LAST), i)
    firsts_table = pa.table({"digest": pa.array(list(firsts), pa.binary()), "first_id": pa.array(list(firsts.values()), pa.int64())})
    ids = pa.Table.from_batches(list(R._ship_ids(labels)(iter(firsts_table.to_batches()))))
    texts = pa.Table.from_batches(list(R._ship_texts(labels)(iter(blocks.toArrow().to_batches()))))
    monkeypatch.setattr(module, "PIECE", 4000)
    monkeypatch.setattr(module, "WINDOWS", 500)

    def dealt(*tables):
        t = pa.concat_tables(tables).sort_by("kind")
        return [iter(t.filter(pa.compute.equal(t["label"], lab)).to_batches()) for lab in sorted(set(t["label"].to_pylist()))]

    contexts = pa.Table.from_batches([b for part in dealt(ids, shared, texts) for b in R._find_contexts(labels)(part)])
    factors = pa.Table.from_batches([b for part in dealt(contexts) for b in R._find_factors(labels)(part)])
    results = [r for part in dealt(ids, factors, texts) for b in R._drop(part) for r in b.to_pylist()]
    want = {(n, removed, spans, sha) for (i, n, removed, spans, sha) in brute(rows)}
    assert len(results) == len(firsts)
    assert {(r["first_removed"], r["first_spans"], r["first_sha"]) for r in results} <= {w[1:] for w in want}


def test_long_text_in_pieces(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2 * R.PIECE + 5000))
    cut = R.PIECE - 30
    rows = [(1, long[cut - 500: cut + 500]), (2, long), (3, long[-400:] + "x" + long[:300])]
    got = {r.doc_id: r for r in R.remove_repeats(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA)).collect()}
    assert (got[2].n_removed, got[2].n_spans) == (1000, 1)
    assert got[2].kept_sha256 == hashlib.sha256((long[: cut - 500] + long[cut + 500:]).encode()).hexdigest()
    assert (got[3].n_removed, got[3].n_spans) == (700, 2)


def test_edges(spark):
    p = "exactly fifty bytes of a passage, neither more no."
    assert len(p) == 50
    rows = [(1, None), (2, ""), (3, p), (4, p[:-1]), (5, p + p), (6, "a" * 500), (7, "a" * 49), (8, "b" + "a" * 60 + "b"), (3, "other " + p), (3, p), (None, p + "!"), (None, "z" + p)]
    check(spark, rows, 3)
    assert R.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_longest_previous_factors_against_pairs():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        words = rng.integers(0, 2, (R._WORDS, n)).astype(np.uint64) * (rng.random((R._WORDS, n)) < rng.choice([0.02, 0.2])).astype(np.uint64)
        doc = rng.integers(0, 12, n)
        want = [any(doc[j] < doc[i] and (words[:, i] == words[:, j]).all() for j in range(n)) for i in range(n)]
        assert ((R.longest_previous_factors(words, doc) >= R.SPAN) == want).all()
