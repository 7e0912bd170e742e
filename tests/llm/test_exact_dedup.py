import hashlib
import random

from scorelake.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, digest string, keep_id int"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(_norm(t), []).append(i)
    return groups


def _norm(t):
    return (t or "").encode().lower()


def test_cuckoo_insert_find_delete_resize():
    rng = random.Random(5)
    index, live = E.CuckooIndex(buckets=4), {}
    keys = [hashlib.sha256(b"%d" % i).digest() for i in range(3000)]
    for step in range(9000):
        k = rng.choice(keys)
        if rng.random() < 0.35:
            assert (index.delete(k) is not None) == (k in live)
            live.pop(k, None)
        else:
            index.add_rows(k, step, 1)
            live[k] = step
        assert index.size == len(live)
    for k in keys:
        e = index.find(k)
        assert (e.keep if e else None) == live.get(k)
    assert len(list(index)) == len(live)


def test_edges(spark):
    rows = [(1, "Abc", "x", 1), (2, "aBC", None, 2), (3, None, "x", 1), (4, "", "y", 1), (5, "ÀB", "y", 1), (6, "àb", "y", 1),
            (7, "z" * 2_000_000, "", 0), (7, "z" * 2_000_000, "", 0), (None, "abc", "", 0), (7, "other", "", 0)]
    rows += [(100 + i, "hot", "", 0) for i in range(200)]
    got = E.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    groups = brute([(r[0], r[1]) for r in rows])
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max(i for i in ids if i is not None)
    for sha, ids in by_sha.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert {(r.doc_id, r.keep_id) for r in got if r.text_sha256 == hashlib.sha256(b"abc").hexdigest()} == {(1, 2), (2, 2), (None, 2)}


def test_keep_last_copies(spark):
    rows = [(1, "Abc", "x", 1), (2, "aBC", "k", 2), (7, "q", "", 0), (7, "q", "", 0), (None, "n", None, None), (9, None, "", 0)]
    got = E.keep_last_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text, r.digest) for r in got) == [("2", "aBC", "k"), ("7", "q", ""), ("9", None, ""), ("None", "n", None)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.exact_dedup(df).count() == 0
    assert E.keep_last_copies(df).count() == 0
