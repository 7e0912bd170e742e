"""Oversampling invariants: exact k-NN, balanced classes, bounded values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import neighbours as N
from scorelake.operators import resample as RS


def brute(pts, k):
    out = {}
    for pid, c, v in pts:
        near = sorted((sum(abs(a - b) for a, b in zip(v, w)), nid, n - (nid == pid)) for nid, n, w in pts if n - (nid == pid) > 0)
        want, taken = [], 0
        for d, nid, a in near:
            if taken >= k:
                break
            want.append((nid, min(a, k - taken), d))
            taken += want[-1][1]
        out[pid] = want
    return out


@pytest.mark.parametrize("dims,n,block,clusters", [(2, 90, 16, 5), (32, 150, 20, 6), (32, 150, 2048, 1), (3, 4, 2, 1)])
def test_knn_matches_brute_force(spark, dims, n, block, clusters):
    rnd = random.Random(5)
    centres = [[rnd.random() * 4 for _ in range(dims)] for _ in range(clusters)]
    pts = [(f"p{i}", rnd.choice([1, 1, 2, 9]), [x + rnd.random() * 0.2 for x in rnd.choice(centres)]) for i in range(n)]
    pts += [("twin", 1, pts[0][2]), ("alone", 1, [9.0] * dims)]
    got = {}
    for r in N.knn(spark.createDataFrame(pts, "pid string, c long, vec array<double>"), 4, block).collect():
        got.setdefault(r["pid"], []).append((r["dist"], r["nid"], r["w"]))
    for pid, want in brute(pts, 4).items():
        mine = sorted(got[pid])
        assert [(n, w) for _, n, w in mine] == [(n, w) for n, w, _ in want]
        assert all(abs(a[0] - d) < 1e-9 for a, (_, _, d) in zip(mine, want))


def test_no_block_holds_all_and_few_are_visited(spark):
    rnd = random.Random(1)
    pts = [(f"p{c}_{i}", 1, [c * 5 + rnd.random() for _ in range(32)]) for c in range(8) for i in range(40)]
    seen = spark.sparkContext.accumulator(0)
    visit = N._visit

    def counting(dims, k):
        inner = visit(dims, k)

        def run(batches):
            def spy():
                for b in batches:
                    seen.add(int((b.column("side").to_numpy() == 1).sum()))
                    yield b
            return inner(spy())
        return run

    N._visit = counting
    try:
        assert N.knn(spark.createDataFrame(pts, "pid string, c long, vec array<double>"), 5, 20).count() == 320 * 5
    finally:
        N._visit = visit
    assert 320 <= seen.value < 320 * 8  # of 16 blocks or more, each point visits those of its own cluster


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "pid string, c long, vec array<double>")
    assert N.knn(none, 3).count() == 0
    assert N.knn(spark.createDataFrame([("a", 1, [0.0])], none.schema), 3).count() == 0
    assert [(r.nid, r.w) for r in N.knn(spark.createDataFrame([("a", 3, [0.0])], none.schema), 5).collect()] == [("a", 2)]


def _rows(spark, share=0.2):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("abcd"), rnd.choice("xy"), float(rnd.randint(0, 9)), 1 if rnd.random() < share else 0)
            for i in range(400)]
    return spark.createDataFrame(rows, "id long, f1 string, f2 string, t double, label int")


@pytest.mark.parametrize("share", [0.2, 0.8])
def test_smoten_balances_classes(spark, share):
    df = _rows(spark, share)
    n_pos = df.filter("label = 1").count()
    n_neg = df.filter("label = 0").count()
    syn = RS.oversample(df, ["f1", "f2"], [], "label", 5)
    assert syn.count() == abs(n_neg - n_pos) and {r.label for r in syn.select("label").distinct().collect()} == {int(share < 0.5)}
    assert syn.filter(F.col("f1").isNull() | ~F.col("f1").isin(list("abcd"))).count() == 0
    each = [r["count"] for r in syn.groupBy("origen").count().collect()]
    assert max(each) - min([*each, min(n_pos, n_neg) and max(each) - 1]) <= 1


def test_smote_nc_interpolates_inside_minority_range(spark):
    df = _rows(spark)
    lo, hi = df.filter("label = 1").agg(F.min("t"), F.max("t")).first()
    syn = RS.oversample(df, ["f1", "f2"], ["t"], "label", 5)
    assert syn.count() == df.filter("label = 0").count() - df.filter("label = 1").count()
    assert syn.filter((F.col("t") < lo) | (F.col("t") > hi) | F.col("t").isNull()).count() == 0


def test_a_single_minority_row_is_copied(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1), (2, "b", 3.0, 0), (3, "b", 4.0, 0), (4, None, 5.0, 0)], "id long, f string, t double, label int")
    assert sorted((r.f, r.t) for r in RS.oversample(df, ["f"], ["t"], "label", 5).collect()) == [("a", 2.0), ("a", 2.0)]
    assert RS.oversample(df.where("label = 0"), ["f"], ["t"], "label", 5).count() == 0


def test_survey_rows_are_stored_before_they_are_passed_over(spark):
    """Splits and oversampling aggregated all answers anew in every pass."""
    from scorelake.plans import resample, trees

    from conftest import SF_SMALL
    for rows in (resample._survey(spark, SF_SMALL), trees._labeled(spark, SF_SMALL)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan.lower() and "Aggregate" not in plan


def test_distances_are_the_plain_ones_in_a_small_buffer():
    """Sums in the same order, whatever the number of rows; an own place with one row has none to give."""
    rnd = np.random.default_rng(2)
    for rows in (0, 1, N.ROWS, 2 * N.ROWS + 3):
        a, b = rnd.random((rows, 7)), rnd.random((5, 7))
        want = np.zeros((rows, 5))
        for d in range(7):
            want += np.abs(a[:, d, None] - b[None, :, d])
        assert (N.distances(a, b) == want).all()
    ids, pts = np.array(["a", "b", "c"], object), np.array([[0.0], [1.0], [3.0]])
    got = N._nearest(ids, pts, ids, pts, np.array([1, 2, 0]), {"a": [0], "b": [1], "c": [2]}, 2)
    assert [x.tolist() for x in got] == [[0, 1, 1, 2, 2], [1, 1, 0, 1, 0], [1.0, 0.0, 1.0, 2.0, 3.0], [2, 1, 1, 2, 1]]


def test_few_valued_features_send_no_more_than_k_results(spark, monkeypatch):
    """A query's results came from every block that it visited, and each pair was summed feature by feature."""
    rnd = random.Random(3)
    levels = [[rnd.random() / 50 for _ in range(6)] for _ in range(32)]
    pts = [(f"p{i}", rnd.choice([1, 1, 2]), [rnd.choice(v) for v in levels] + [rnd.randint(0, 79) / 790]) for i in range(300)]
    pts += [(f"twin{i}", 1, pts[0][2]) for i in range(6)] + [("none", 0, pts[1][2]), ("odd", 1, [float("nan")] * 33)]
    sent, take = [], N._take
    monkeypatch.setattr(N, "_take", lambda found, k: sent.append(found.count()) or take(found, k))
    got = {}
    for r in N.knn(spark.createDataFrame(pts, "pid string, c long, vec array<double>"), 4, 20).collect():
        got.setdefault(r["pid"], []).append((r["dist"], r["nid"], r["w"]))
    for pid, want in brute(pts[:-1], 4).items():
        mine = sorted(got[pid])
        assert [(n, w) for _, n, w in mine] == [(n, w) for n, w, _ in want]
        assert all(abs(a[0] - d) < 1e-9 for a, (_, _, d) in zip(mine, want))
    assert "odd" not in got and max(sent) <= 2 * 4 * len(pts)


def test_bounds_hold_every_near_pair():
    rnd = np.random.default_rng(8)
    values = {f: rnd.random(6).tolist() for f in range(5)} | {5: [0.5]}
    vec = np.stack([np.array(values[f])[rnd.integers(0, len(values[f]), 200)] for f in range(6)] + [1e6 + rnd.random(200)], 1)
    space = N.Space(7, values, vec.min(0).tolist(), vec.max(0).tolist())
    reach = rnd.random(200) * 2
    q, o = space.within(space.sides(vec), space.rest(vec), space.sides(vec) * space.half, space.rest(vec), reach)
    want = N.distances(vec, vec) <= reach[:, None]
    held = np.zeros_like(want)
    held[q, o] = True
    assert not (want & ~held).any() and held.sum() < 1.01 * want.sum() + 50
