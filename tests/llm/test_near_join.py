import itertools
import random
import re
import string
from collections import defaultdict

import numpy as np
import pytest

from scorelake.llm import components as C
from scorelake.llm import near_join as N

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, digest string, tile int, n long"


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    """(doc_id, text) rows: {doc_id: component}; all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    forest, has = C.Forest(), defaultdict(list)
    for p, (_, s) in enumerate(sets):
        for x in s:
            has[x].append(p)
    pairs = {(p, q) for ps in has.values() for p, q in itertools.combinations(ps, 2)} if len(sets) > 400 else itertools.combinations(range(len(sets)), 2)
    for p, q in pairs:
        (i, s), (j, t) = sets[p], sets[q]
        c = len(s & t)
        if s and t and c * den >= num * (len(s) + len(t) - c):
            forest.join(i, j)
    return {i: forest.root(i) for i, _ in rows}, {(i, len(s)) for i, s in sets}


def check(spark, rows, k, num, den):
    got = N.near_groups(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).repartition(4), k, num, den).collect()
    want, sizes = brute(rows, k, num, den)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == want
    return want


def edited(rng, words, vocab, rate):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < rate / 3 else [rng.choice(vocab)] if r < 2 * rate / 3 else [w, rng.choice(vocab)] if r < rate else [w]
    return out


def corpus(seed, bases, copies, lengths, rate):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(800)] + ["The", "of", "é"]
    shared = [rng.choice(vocab) for _ in range(20)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(vocab) for _ in range(rng.choice(lengths))]
        if rng.random() < 0.3:
            base += shared
        for _ in range(rng.randint(1, copies)):
            words = edited(rng, base, vocab, rng.choice(rate))
            rows.append(" ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed,k,num,den,rate", [(1, 3, 90, 100, (0.0, 0.01, 0.02, 0.04)), (2, 5, 8, 10, (0.0, 0.01, 0.03, 0.06)), (3, 1, 1, 2, (0.1, 0.3))])
def test_against_all_pairs(spark, seed, k, num, den, rate):
    want = check(spark, corpus(seed, 70, 5, (1, 2, 3, 5, 8, 12, 18, 25, 40, 60, 150, 400), rate), k, num, den)
    assert 20 < len(set(want.values())) < len(want)


def test_large_block_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 12)
    want = check(spark, corpus(5, 2, 150, (80,), (0.01, 0.03, 0.05)), 3, 90, 100)
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("seed,rate", [(15, (0.0, 0.01, 0.03, 0.06)), (16, (0.1, 0.2))])
def test_large_blocks_split_by_finer_keys(spark, monkeypatch, seed, rate):
    monkeypatch.setattr(N, "TILE", 6)
    rows = corpus(seed, 40, 12, (12, 25, 60, 150, 400, 1200), rate)
    rows += [(rows[0][0], rows[1][1]), (5000, rows[0][1]), (5001, None)]
    frame = spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).repartition(4)
    kept = {r.doc_id for r in N.keep_one_of_each(frame, 5, 8, 10).collect()}
    assert kept == set(brute(rows, 5, 8, 10)[0].values())


def test_keys_make_every_similar_pair_meet():
    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (8, 10)):
        for n in list(range(1, 130)) + [300, 1000, 5000]:
            for _ in range(3):
                s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                # as far apart as the threshold allows, in three mixes of removed and added
                for drop in {0, int(n * (den - num) / den), int(n * (den - num) / den / 2)}:
                    left = rng.permutation(s)[: n - drop]
                    more = max(0, (len(left) * den) // num - n)
                    t = np.unique(np.concatenate((left, rng.integers(0, 2**63, more, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
                    c = len(np.intersect1d(s, t))
                    if len(t) == 0 or c * den < num * (len(s) + len(t) - c) or (len(s) == len(t) == c):
                        continue
                    mine, other = ({c: k for c, k in zip(N.classes_of(len(x), num, den), N.keys_of(x, num, den))} for x in (s, t))
                    assert any(len(np.intersect1d(mine[c], other[c])) for c in mine.keys() & other.keys()), (n, drop, num)


def test_finer_keys_make_every_similar_pair_meet():
    rng = np.random.default_rng(6)
    for num, den in ((90, 100), (8, 10)):
        low, parts = N.size_classes(num, den)
        first = low[next(c for c, p in enumerate(parts) if p >= N.FEW_PARTS)]
        for n in (first, first + 7, 200, 300, 1000, 5000):
            s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            for drop in {0, int(n * (den - num) / den), int(n * (den - num) / den / 2)}:
                left = rng.permutation(s)[: n - drop]
                t = np.unique(np.concatenate((left, rng.integers(0, 2**63, max(0, (len(left) * den) // num - n), dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
                both = [c for c in N.classes_of(len(s), num, den) if c in N.classes_of(len(t), num, den) and parts[c] >= N.FEW_PARTS]
                met = [len(np.intersect1d(N.finer_keys(s, c, num, den), N.finer_keys(t, c, num, den))) for c in both]
                assert not both or any(met), (n, drop, num)


def test_shared_passages_make_no_large_tiled_block(spark, monkeypatch):
    """Texts that share passages, and nothing more, met in chains: all in one
    block, of which every tile travelled to every other."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(5000)]
    passages = [[rng.choice(vocab) for _ in range(90)] for _ in range(3)]
    rows = []
    for _ in range(240):
        own = [rng.choice(vocab) for _ in range(210)]
        rows.append(" ".join(own[:100] + rng.choice(passages) + own[100:]))
    rows += [t + " more" for t in rows[:20]]
    rows = list(enumerate(rows))
    monkeypatch.setattr(N, "TILE", 12)
    placed, sent, split, tile_links = [], [], N._split_wide, N._tile_links
    monkeypatch.setattr(N, "_split_wide", lambda sets, before, *a: placed.append(before.where("tiles > 1").count()) or split(sets, before, *a))
    monkeypatch.setattr(N, "_tile_links", lambda sets, members, *a: sent.append(members.count()) or tile_links(sets, members, *a))
    frame = spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA).repartition(4)
    kept = {r.doc_id for r in N.keep_one_of_each(frame, 5, 8, 10).collect()}
    assert kept == set(brute(rows, 5, 8, 10)[0].values()) and len(kept) == 240
    assert placed[0] > 200 and sum(sent) <= 3 * len(rows)


def test_tree_join_against_all_pairs():
    rng = np.random.default_rng(0)
    for trial in range(20):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, 2**63, 60, dtype=np.uint64), base))[: rng.integers(20, 61)] for _ in range(rng.integers(2, 90))]
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (c := len(np.intersect1d(sets[i], sets[j]))) * 10 >= 8 * (len(sets[i]) + len(sets[j]) - c)}
        tree, got = N.SignatureTree(sets, N.bitmap_bits(sets)), []

        class All:
            apart = staticmethod(lambda p, q: True)
            any_apart = staticmethod(lambda a, b: True)

        N.tree_join(tree, tree, 8, 10, All, lambda p, q: got.append((min(p, q), max(p, q))))
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("per_task", [60, C.EDGES])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(C, "EDGES", per_task)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(250)] + [(7, 7)]
    forest = C.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = C.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == {x: forest.root(x) for e in edges if e[0] != e[1] for x in e}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark):
    base = " ".join(f"a{i}" for i in range(60))
    rows = [(5, base), (6, base.upper()), (3, base + " b"), (9, None), (2, ""), (1, " \n"), (7, "one two"), (8, "ONE two"), (4, "one two three"),
            (11, "x " * 50_000), (12, "x x x"), (13, " ".join(f"z{i}" for i in range(100_000)))]
    want = check(spark, rows, 3, 90, 100)
    assert want[5] == want[6] == 3 and want[8] == 7 and want[12] == 11 and want[9] == 9
    more = rows + [(None, base), (None, None), (3, base + " b"), (3, "one two")]
    got = {(r.doc_id, r.component_id) for r in N.near_groups(spark.createDataFrame([(i, t, "", 0, 0) for i, t in more], SCHEMA), 3, 90, 100).collect()}
    assert got == {(5, 3), (6, 3), (3, 3), (9, 9), (2, 2), (1, 1), (7, 3), (8, 3), (4, 4), (11, 11), (12, 11), (13, 13), (None, None)}
    empty = spark.createDataFrame([], SCHEMA)
    assert N.near_groups(empty, 3, 90, 100).count() == 0 and N.keep_one_of_each(empty).count() == 0
    kept = N.keep_one_of_each(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "digest", "tile", "n"] and {r.doc_id for r in kept.collect()} >= {3, 9, 2, 1, 7, 4, 13}
