"""Cases beyond the clean test tables: tiny scores, null groups, many levels,
deep trees, lost and changed artefacts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import audit as A
from scorelake.operators import encode, scorecard, split
from scorelake.operators import gbt as G
from scorelake.operators import metrics as M
from scorelake.operators import treeshap as TS
from scorelake.sources import files


def test_auc_of_tiny_and_bunched_scores(spark):
    rows = [(1e-13, 0), (2e-13, 0), (3e-13, 1), (4e-13, 1)]
    assert M.auc(spark.createDataFrame(rows, "p double, label int")).first()["auc"] == 1.0
    rng = random.Random(1)
    rows = [(0.5 + rng.randint(0, 3) * 1e-15, rng.randint(0, 1), rng.choice(["a", None])) for _ in range(300)]
    for r in M.auc(spark.createDataFrame(rows, "p double, label int, g string"), by=["g"], buckets=5).collect():
        pos = [p for p, y, g in rows if y == 1 and g == r.g]
        neg = [p for p, y, g in rows if y == 0 and g == r.g]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert r.auc == pytest.approx(want, abs=1e-6)


def test_auc_numerator_beyond_64_bits(spark):
    big = spark.createDataFrame([(3_000_000_000, 3_000_000_000)], "pos long, neg long")
    assert int(big.select(M.pair_wins("pos", F.col("neg"), "neg").alias("n")).first().n) == 3 * 3_000_000_000 ** 2


def test_null_levels_and_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3], i % 2, "train" if i < 9 else "test") for i in range(12)], "id long, f string, label int, split string")
    assert encode.ordered_target_encoding(df, ["f"]).count() == 12
    parts = split.stratified_split(spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 0)], "id long, label int"), test_pct=50)
    assert parts.count() == 4
    card = scorecard.fit(df, ["f"])
    weight = {r.level: r.weight for r in card.collect()}
    got = {r.f: r.w_f for r in scorecard.score(df, card, ["f"]).collect()}
    assert got[None] == weight[None] and got["a"] == weight["a"]


def trained(spark, levels, trees, depth, names=("x", "y", "z", "u", "v", "w")):
    rng = random.Random(3)
    rows = [(i, *[f"l{rng.randint(0, levels - 1):02d}" for _ in names]) for i in range(500)]
    data = [(*r, int((hash((r[1], r[2])) ^ i) % 3 == 0 or r[3] < r[4]), "train") for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, f"id long, {', '.join(n + ' string' for n in names)}, label int, split string")
    return df, list(names), G.fit(df, list(names), trees, depth=depth, min_instances=2)


def test_many_levels(spark):
    df, names, model = trained(spark, 70, 2, 3)
    assert G.score(model, df, names).count() == 500


def test_tree_shap_of_deep_trees_sums_to_the_logit(spark, tmp_path):
    df, names, model = trained(spark, 4, 3, 6)
    trees = TS.trees_from_saved(spark, TS.save_model(model.stages[-1], str(tmp_path / "m")))
    assert max(len(x["conds"]) for x in trees.leaves) > 3
    rows = model.stages[0].transform(G.as_strings(df, names)).limit(60)
    phi = TS.attributions(rows, trees, [f"{n}_idx" for n in names], names)
    total = {r.id: r.s for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    base = TS.base_value(trees)
    for r in G.score(model, df, names).where(F.col("id").isin(list(total))).collect():
        assert base + total[r.id] == pytest.approx(math.log(r.p / (1 - r.p)), abs=1e-9)


def test_first_trees_are_a_prefix(spark):
    df, names, model = trained(spark, 4, 5, 3)
    *prep, trees = model.stages
    short = G.fit(df, names, 2, depth=3, min_instances=2)
    cut = G.first_trees(trees, 2)
    assert cut.getNumTrees == 2
    data = G.as_strings(df, names)
    for s in prep:
        data = s.transform(data)
    a = {r.id: r.probability[1] for r in cut.transform(data).select("id", "probability").collect()}
    b = {r.id: r.p for r in G.score(short, df, names).collect()}
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
    assert G.best_prefix([3.0, 2.0, 2.5, 2.6, 1.0], 2) == 2 and G.best_prefix([3.0, 2.0, 2.5, 2.6, 1.0], 3) == 5


def test_audit_sees_lost_and_changed_models(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], int(i % 3 == 0)) for i in range(60)], "id long, f string, label int")
    paths = A.train_and_store(df, ["f"], 1.0, 20, 25, f"file://{tmp_path}/a")
    good = A.audit(df, ["f"], paths, 20, 25).first()
    assert good.estado == "PRODUCTION READY" and good.model_size_kb > 0
    card = spark.createDataFrame(spark.read.parquet(paths["model"]).withColumn("weight", -F.col("weight")).collect(), spark.read.parquet(paths["model"]).schema)
    files.save_table_model(card, paths["model"])
    changed = A.audit(df, ["f"], paths, 20, 25).first()
    assert changed.estado == "AUDIT FAILED" and not changed.model_sha256_ok
    lost = A.audit(df, ["f"], {**paths, "model": f"file://{tmp_path}/none"}, 20, 25).first()
    assert lost.estado == "AUDIT FAILED" and not lost.model_path_exists
    assert [r.existe for r in files.artifact_manifest(spark, f"file://{tmp_path}/none").collect()] == [False]
