import hashlib
import random
import re
from collections import Counter

import xxhash

from scorelake.llm import order_minhash as O

M64, POS = (1 << 64) - 1, O._POS
SYMBOL = re.compile("[^\\s⺀-\U0010FFFF]{1,16}|\\S", re.ASCII)
SCHEMA = "doc_id long, text string, sig string, range int"


def xx(*parts):
    seed = 42
    for p in parts:
        if p is not None:
            raw = p.encode() if isinstance(p, str) else (p & M64).to_bytes(8, "little") if p >= 1 << 31 or p < -(1 << 31) else p
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def long(v):
    return (v & M64).to_bytes(8, "little")


def signature(text):
    """The same selection, written with plain lists."""
    w, seen, items = SYMBOL.findall(text), Counter(), []
    mers = [xx(x, w[i + 1] if i + 1 < len(w) else None) & ~POS & M64 for i, x in enumerate(w)]
    for i, m in enumerate(mers):
        h = xxhash.xxh64_intdigest(seen[m].to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(long(m), seed=42)) & ~POS & M64
        seen[m] += 1
        items.append((h, i))
    out = []
    for slot in range(O.SLOTS):
        # slots compare signed numbers; within a slot that is the order of the bits
        mine = sorted(x for x in items if x[0] >> (64 - O.SLOT_BITS) == slot)[: O.PICK]
        if mine:
            seed = 42
            for h, _ in sorted(mine, key=lambda x: x[1]):
                seed = xxhash.xxh64_intdigest(long(h >> O.POS_BITS), seed=seed)
            out.append(slot << 24 | seed & 0xFFFFFF)
    return out


def likeness(a, b):
    used = len({x >> 24 for x in a} | {x >> 24 for x in b})
    return len(set(a) & set(b)) / used if used else 1.0


def check(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    got = {r.doc_id: r for r in O.fingerprints(spark.createDataFrame([(i, t, "", 0) for i, t in zip(ids, texts)], SCHEMA).repartition(5)).collect()}
    order = sorted(ids)
    text = {i: t or "" for i, t in zip(ids, texts)}
    for k, i in enumerate(order):
        t, nxt, r = text[i], text[order[(k + 1) % len(order)]], got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = signature(t), signature(edited), signature(nxt)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:08x}" for x in a) and r.edited_fingerprint == "".join(f"{x:08x}" for x in b)
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, c)) < 1e-12
    assert len(got) == len(ids)
    return got


def test_against_plain_lists(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "a", "ré", "x" * 40, "你好吗", "🙂", "\n", "end."] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab[: rng.choice([2, 9, 69])]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    check(spark, texts + [None, "", " ", "one", "a " * 3000], [7 * i + 3 for i in range(65)])


def test_corpus_and_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = check(spark, [r.text for r in docs], [r.doc_id for r in docs])
    assert sum(r.near_edited for r in got.values()) > 3 * sum(r.near_next for r in got.values())
    words = docs[0].text.split()
    a, moved = signature(" ".join(words)), signature(" ".join(words[len(words) // 2:] + words[: len(words) // 2]))
    assert likeness(a, a) == 1 and likeness(a, moved) < 0.8  # the same k-mers in another order


def test_edges(spark):
    assert O.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = O.fingerprints(spark.createDataFrame([(1, "a b c d", "", 0)], SCHEMA)).collect()
    assert one[0].near_next == 1.0
    rows = [(1, "x y", "", 0), (1, "x y", "", 0), (1, "other", "", 0), (None, "n", "", 0), (None, None, "", 0)]
    got = O.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None", "None"]
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 1
    long = O.fingerprints(spark.createDataFrame([(1, "word and " * 100_000, "", 0), (2, "z" * 500_000, "", 0)], SCHEMA)).collect()
    assert all(0 <= r.near_edited <= 1 for r in long)
