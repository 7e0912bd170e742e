"""The registered runs record all their settings, and patience decides."""

from pyspark.sql import functions as F

from scorelake.operators import gbt as G
from scorelake.operators import runs as RN
from scorelake.plans.model import FEATURES, split_frame
from scorelake.sources import testdata as td

from conftest import SF_SMALL


def test_runs_have_settings_of_their_own():
    assert [c["trees"] for c in RN.GBT_CONFIGS] == [100] * 4 and [c["depth"] for c in RN.GBT_CONFIGS] == [6, 4, 5, 3]
    assert [c["min_instances"] for c in RN.GBT_CONFIGS] == [1, 1, 1, 25]
    for c in RN.GBT_CONFIGS:
        assert ("patience" in c) == bool(c["val_pct"]) and c.get("patience", 0) < c["trees"]
        assert (c["tags"]["ablation"] == "Yes") == (not set(c["features"]) & set(td.DEMOGRAPHIC)) and set(td.SURVEY_FEATURES) <= set(c["features"])


def test_patience_ends_the_boosting(spark):
    rows = split_frame(spark, SF_SMALL, 20, 25)
    model, best, losses = G.fit_best_prefix(rows, FEATURES, 3000, 4, step=0.1)
    assert len(losses) < 3000 and len(losses) - best >= 4
    assert min(losses[: best + 4]) == losses[best - 1] and model.stages[-1].getNumTrees == best


def test_ran_out():
    assert not G.ran_out([5, 4, 3, 4, 4], 3) and G.ran_out([5, 4, 3, 4, 4, 4], 3) and G.ran_out([5, 6, 6, 6, 1, 2], 3)
    assert not G.ran_out([3, 2, 1], 3)


def test_a_fit_is_stored_once(spark, tmp_path, monkeypatch):
    rows = split_frame(spark, SF_SMALL, 20, 25)
    cfg = {"name": "x", "features": FEATURES, "trees": 3, "depth": 2, "step": 0.1, "min_instances": 1}
    base = f"file://{tmp_path}"
    first, trees = G.stored_fit(rows, cfg, base)
    with monkeypatch.context() as m:
        m.setattr(G, "fit_run", None)
        again, n = G.stored_fit(rows.repartition(5), {**cfg, "name": "y"}, base)  # the same rows and settings
    assert trees == n == 3
    a = {r.id: r.p for r in G.score(first, rows, FEATURES).select("id", "p").collect()}
    assert {r.id: r.p for r in G.score(again, rows, FEATURES).select("id", "p").collect()} == a
    assert G.fingerprint(rows, {**cfg, "step": 0.2}) != G.fingerprint(rows, cfg) != G.fingerprint(rows.where(F.col("id") > rows.agg(F.min("id")).first()[0]), cfg)
