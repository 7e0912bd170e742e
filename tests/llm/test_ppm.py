"""Partial matching against a plain trie, cases, and the sum of probabilities."""
import binascii
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from scorelake.llm import ppm as P

SCHEMA = "doc_id long, text string, kind int, block string, held int, score string"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def held(i):
    return i is not None and binascii.crc32(str(i).encode()) % 10 == 0


def symbols(text):
    return [P.START] * P.ORDER + list((text or "").translate(LOW).encode()) + [P.END]


def trie(rows):
    follow = defaultdict(Counter)
    for i, t in rows:
        if not held(i):
            s = symbols(t)
            for at in range(P.ORDER, len(s)):
                for k in range(P.ORDER + 1):
                    follow[tuple(s[at - k: at])][s[at]] += 1
    return follow


def probability(follow, context, symbol):
    p, out = 1.0, set()
    for k in range(P.ORDER, -1, -1):
        seen = follow.get(tuple(context[P.ORDER - k:]))
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in out}
        whole = 2 * sum(left.values())
        if symbol in left:
            return p * (2 * left[symbol] - 1) / whole
        if whole:
            p *= len(left) / whole
        out |= set(seen)
    return p / (257 - len(out))


def expected(rows):
    follow, words = trie(rows), Counter()
    tokens = {n: re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None] for n, (_, t) in enumerate(rows)}
    for n, (i, _) in enumerate(rows):
        if not held(i):
            words.update(tokens[n])
    total = sum(words.values())
    out = []
    for n, (i, t) in enumerate(rows):
        s = symbols(t)
        score = sum(math.log10(probability(follow, s[at - P.ORDER: at], s[at])) for at in range(P.ORDER, len(s)))
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in tokens[n])
        out.append((i, held(i), len(tokens[n]), sum(words[w] > 0 for w in tokens[n]), total, base, score))
    return out


def check(spark, rows):
    got = P.score(spark.createDataFrame([(i, t, 9, "x", 7, "y") for i, t in rows], SCHEMA).repartition(3)).collect()
    key = lambda r: (str(r[0]), round(r[5], 4), round(r[6], 3))
    got, want = sorted([tuple(r) for r in got], key=key), sorted(expected(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6 * (10 + len(str(b))) + 1e-6 * 2000)


def corpus(n=120):
    rng = random.Random(2)
    parts = ["the ", "cat", "THE", " sat\n", "é", "ñandú ", "0 1 2", "\t", "on the mat "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (n + 2, "only here: \U0001F600 zq")]


def test_against_a_plain_trie(spark):
    check(spark, corpus())


def test_cases(spark, monkeypatch):
    check(spark, [(1, "alone")])
    check(spark, [(None, None)])
    only_held = [(i, "held text") for i in range(200) if held(i)][:3]
    check(spark, only_held)  # nothing to learn from
    assert P.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_blocks_and_salts_do_not_matter(spark, monkeypatch):
    rows = corpus(40) + [(500, "a long text of some words and " * 400), (501, "x" * 3000)]
    frame = spark.createDataFrame([(i, t, 9, "x", 7, "y") for i, t in rows], SCHEMA)
    whole = sorted(map(str, P.score(frame).collect()))
    monkeypatch.setattr(P, "PIECE", 1000)
    pieces = list(P.groups(iter([np.frombuffer(("word " * 900).encode(), np.uint8)])))
    assert len(pieces) > 3 and sum(len(g.grams()[0]) for g in pieces) == 4501 and sum(len(g.words()[0]) for g in pieces) == 900
    one = P.Group()
    one.add(0, np.frombuffer(("word " * 900).encode(), np.uint8), P._NEW, True)
    assert sorted(np.concatenate([g.grams()[0] for g in pieces])) == sorted(one.grams()[0])
    monkeypatch.undo()
    salted = P.merged

    def twice(parts, salts):
        return salted(parts, 3)
    monkeypatch.setattr(P, "merged", twice)
    assert sorted(map(str, P.score(frame.repartition(6)).collect())) == whole


def test_probabilities_of_a_context_add_up_to_one():
    rng = random.Random(5)
    counts = Counter()
    for _ in range(300):
        s = symbols("".join(rng.choice("abcde ") for _ in range(rng.randint(0, 12))))
        for at in range(P.ORDER, len(s)):
            g = 0
            for x in s[at - P.ORDER: at + 1]:
                g = g << 9 | x
            counts[g] += 1
    grams = np.array(sorted(counts), np.int64)
    n = np.array([counts[g] for g in grams.tolist()], np.int64)
    pairs, m = P._distinct(grams & (1 << 18) - 1, n)
    model = P.Trie(pairs, m).grown(grams, n)
    for context in ([P.START] * 5, [100, 97, 98, 99, 32], [100, 200, 97, 98, 99], [1, 2, 3, 4, 5], [P.START, P.START, P.START, 97, 97]):
        g = 0
        for x in context:
            g = g << 9 | x
        every = np.array([g << 9 | s for s in [*range(256), P.END]], np.int64)
        assert (10 ** model.log10(every)).sum() == pytest.approx(1, abs=1e-9)


def test_the_model_knows_the_language_of_its_texts(spark):
    from scorelake.llm.common import table
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").where("length(text) > 200")
    mixed = docs.unionByName(docs.selectExpr("doc_id", "reverse(text) AS text"))
    own, back = {}, {}
    for r in P.score(mixed, held=P.F.col("text").isNull()).collect():  # both are learned: any difference is the texts' own
        own.setdefault(r.doc_id, []).append(r.score)
    plain = {r.doc_id: r.score for r in P.score(docs).where("held_out").collect()}
    frame = docs.where(P.held_out()).selectExpr("doc_id", "reverse(text) AS text").unionByName(docs.where(~P.held_out()))
    back = {r.doc_id: r.score for r in P.score(frame).where("held_out").collect()}
    assert all(len(v) == 2 for v in own.values()) and len(plain) > 5 and all(plain[i] > back[i] for i in plain)
