import random
from collections import Counter, defaultdict

import pytest

from scorelake.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, target string, bucket int"


def fill(sizes, weights, budget, epochs):
    """Plain water-filling over {source: size}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in clamped)
        free = [s for s in names if s not in clamped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= epochs * sizes[s]}
        if not over:
            return {**share, **{s: epochs * sizes[s] for s in clamped}}
        clamped |= over
        if len(clamped) == len(names):
            return {s: epochs * sizes[s] for s in names}


def corpus(n=400):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) + rng.choice(["", "\n", " x"]), rng.choice(["hot"] * 6 + ["a", "b", "É", "z", None]), "t", 1) for i in range(n)]
    return rows + [(n, None, "a", None, None), (n + 1, "", "b", "", 0), (n + 2, "long " * 100_000, "z", "", 0), (7, rows[7][1], rows[7][2], "", 1), (None, "p q", "a", "", 2)]


@pytest.mark.parametrize("weights,budget,epochs", [((3, 1, 2), 1.5, 2.0), ((1,), 0.4, 1.0), ((5, 1), 3.0, 2.0)])
def test_targets_and_words_taken(spark, weights, budget, epochs):
    rows = corpus()
    got = M.mix(spark.createDataFrame(rows, SCHEMA), weights, budget, epochs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    sizes, taken = defaultdict(int), Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = fill(sizes, weights, budget, epochs)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= epochs * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_reruns_agree_and_layout_does_not_matter(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    a = sorted(map(str, M.mix(df).collect()))
    assert a == sorted(map(str, M.mix(df.repartition(13, "text")).collect()))


def test_mixed_documents_hold_what_was_taken(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    words = Counter()
    for r in M.mix(df).collect():
        words[r.doc_id] += r.taken
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    texts, seen = {(r[0], r[2]): r[1] or "" for r in rows}, Counter()
    for r in mixed.collect():
        assert texts[r.doc_id, r.source].startswith(r.text)
        seen[r.doc_id] += len(r.text.split())
    assert +seen == +words


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix(df).count() == 0 and M.mixed_documents(df).count() == 0
    assert M.mix(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).first().taken == 0
