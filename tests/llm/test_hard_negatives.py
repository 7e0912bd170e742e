"""Cover-tree search and mining against brute force."""
import random

import numpy as np
import pytest

from scorelake.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score long, shard string"


def floor_rows(rows):
    out = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if sum(x * x for x in ints) >= 1 << 62:
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        out[i] = min(out.get(i, (label, ints)), (label, ints))
    return out


def brute(rows):
    by = floor_rows(rows)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in by.items():
        if a % 50:
            continue
        scored = sorted((-dot(v, w), i, l) for i, (l, w) in by.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(n, i) for n, i, l in scored if l != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, pid, r + 1, i, -p, -n) for r, (n, i) in enumerate(fit[:3])]
    return sorted(out)


def check(spark, rows):
    got = H.hard_negatives(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()))
    want = brute(rows)
    assert got == want and len(set(got)) == len(got)
    return want


def clustered(n, dims, clusters, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)], rng.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("shard,leaf,fan", [(8192, 128, 16), (60, 8, 3), (25, 4, 2)])
def test_against_brute_force(spark, monkeypatch, shard, leaf, fan):
    for name, v in (("SHARD", shard), ("LEAF", leaf), ("FAN", fan), ("BLOCK", 7)):
        monkeypatch.setattr(H, name, v)
    rows = clustered(400, 6, 5, shard)
    rows += [(1000 + i, rows[0][1], 3) for i in range(90)]  # a group of copies, larger than a shard
    assert len(check(spark, rows)) > 20


def test_cases(spark):
    odd = [(0, [1.0, 2.0], 1), (50, None, 1), (100, [1.0, None], 1), (150, [float("nan"), 1.0], 1), (200, [float("inf"), 1.0], 1), (250, [1.0, 1.0], None),
           (None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 0.9], 2), (3, [0.6, 1.0, 0.0, 0.1], 2), (4, [], 1), (5, [0.0, 0.0], 2), (300, [0.0, 0.0], 2),
           (6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (8, [-1.0, -2.0], 1), (9, [1e30, 1.0], 4), (350, [-0.3, 0.2], 5), (10, [0.7, 0.9], 4)]
    check(spark, odd)
    check(spark, [r for r in odd if r[2] == 1])
    check(spark, [])
    big = [(50 * i, [float(1 << 22) + i, -float(1 << 21) * (i % 3)], i % 3) for i in range(12)]  # beyond whole doubles: 64-bit products
    check(spark, big)


def test_bounds_hold_and_nodes_are_skipped():
    rows = clustered(2000, 8, 12, 3, 0.05)
    vec = np.floor(256 * np.array([r[1] for r in rows]))
    cover = H.Cover(float(np.sqrt(np.square(vec).sum(1).max())) * (1 + 1e-12))
    tree = H.Tree(cover, np.arange(2000), np.array([r[2] for r in rows]), vec)
    assert sorted(tree.ids.tolist()) == list(range(2000)) and sum(b - a for a, b in tree.leaves) == 2000
    query = vec[:40]
    norm = np.sqrt(np.square(query).sum(1))
    exact = H.products(query, tree.vec)
    spans = [np.array([[exact[:, a:b].min(1), exact[:, a:b].max(1)] for a, b in tree.leaves])]
    centre, radius, _ = tree.levels[-1]
    low, up = cover.bounds(query, norm, centre, radius)
    assert (low.T <= spans[0][:, 0]).all() and (up.T >= spans[0][:, 1]).all()
    opened = []
    inner = tree._open
    tree._open = lambda leaf, who, *rest: (opened.append(len(who)), inner(leaf, who, *rest))[1]
    whole = np.full((40, 1), H.LEAST + 1), np.full((40, 1), H.MOST)
    tree.search(np.arange(40), tree.label[:40] * 0 + np.array([r[2] for r in rows])[:40], query, *whole, whole[0], True, 5)
    assert sum(opened) < 0.6 * 40 * len(tree.leaves)  # of clusters, most leaves are never opened


def test_children_are_apart_and_covered():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 5))
    points /= np.linalg.norm(points, axis=1)[:, None]
    chosen, owner, best = H.farthest_first(points, 12, 7)
    assert chosen[0] == 7 and len(set(chosen)) == 12
    radius = np.arccos(best.min())
    between = np.arccos(np.clip(points[chosen] @ points[chosen].T, -1, 1))[np.triu_indices(12, 1)]
    assert between.min() >= radius - 1e-9
