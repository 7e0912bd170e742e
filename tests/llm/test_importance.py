"""Bit-sliced weights, CRC-32 of runs and draws against plain Python."""
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from scorelake.llm import importance as I

SCHEMA = "doc_id long, text string, score string, part int, able int, h int"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def buckets(text):
    w = WORD.findall((text or "").translate(LOW))
    return Counter(zlib.crc32(" ".join(w[i: i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)), len(w)


def expected(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text)[0])
    for text in target:
        t.update(buckets(text)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000))))
    out = []
    for i, text in docs:
        f, n = buckets(text)
        w = sum(c * gain(b) for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(f.values()), n, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[5] = k
    return out


def check(spark, docs, target):
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], SCHEMA).repartition(3)
    got = I.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected(docs, target)), key=key)
    return got


def corpus(n=300):
    rng = random.Random(8)
    vocab = ["a", "B", "the", "É", "ñu", "x1", "99", "long" * 90, "don't", "ok"]
    join = [" ", "  ", "-", "\n", "_"]
    docs = [(i, "".join(rng.choice(vocab) + rng.choice(join) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "... !!"), (None, docs[0][1] + " a" * 30), (n + 3, "hot " * 5000)], ["the a ok", None, "é ñu x1 99 the the"]


def test_against_plain_python(spark):
    got = check(spark, *corpus())
    drawn = sorted(r.rank for r in got if r.rank is not None)
    assert drawn == list(range(1, len(drawn) + 1)) and drawn


def test_cases(spark):
    docs, target = corpus(5)
    check(spark, docs, [])
    check(spark, [(1, None)], target)
    check(spark, [], target)
    ties = [(i, "one two three four five six seven eight nine ten " * 3) for i in range(100)]
    check(spark, ties, ["one two"])


def test_blocks_of_words_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000)).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = Counter(np.concatenate([b for _, b in I.feature_buckets(data, off)]).tolist())
    monkeypatch.setattr(I, "BLOCK", 13)
    assert Counter(np.concatenate([b for _, b in I.feature_buckets(data, off)]).tolist()) == whole == buckets(text.decode())[0]


@pytest.mark.parametrize("seed", range(4))
def test_sliced_sums_are_exact(seed):
    rng = np.random.default_rng(seed)
    gain = rng.integers(-(1 << rng.integers(1, 17)), 1 << rng.integers(1, 17), I.BUCKETS)
    counts = np.where(rng.random((9, I.BUCKETS)) < 0.1, rng.integers(0, 1 << rng.integers(1, 20), (9, I.BUCKETS)), 0)
    assert (I.GainPlanes(gain).weigh(counts) == (counts * gain).sum(1)).all()
    for flat in (np.zeros(I.BUCKETS, np.int64), np.full(I.BUCKETS, -1), np.full(I.BUCKETS, 5)):
        assert (I.GainPlanes(flat).weigh(counts) == (counts * flat).sum(1)).all()


def test_crc_of_concatenations():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abc0\xc3\xa9") for _ in range(n)) for n in [1, 2, 5, 255, 256, 257, 600, 70_000, 3]]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = ends - [len(w) for w in words]
    c = I.crc()
    raw = c.of_words(data, begin, ends)
    assert c.finished(raw, ends - begin).tolist() == [zlib.crc32(w) for w in words]
    two = c.moved(raw[:-1], (ends - begin)[1:]) ^ raw[1:]
    assert c.finished(two, (ends - begin)[1:] + (ends - begin)[:-1]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]
