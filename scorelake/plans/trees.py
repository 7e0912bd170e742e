"""Boosted-tree queries at survey width (no SQL; tests hold them against
invariants): scores, importance, attribution, the four training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit as A
from ..operators import gbt as G
from ..operators import runs as RN
from ..operators import treeshap as TS
from ..operators.split import stratified_split
from ..session import cut_lineage, shared_path
from ..sources import files
from ..sources import testdata as td
from .registry import query

HARDENED = RN.GBT_CONFIGS[-1]
FEATURES = HARDENED["features"]


def _home(spark) -> str:
    """Where fits are kept, for all queries of an application's shared folder."""
    return shared_path(spark, "gbt", unique=False)


def _labeled(spark, sf_dir):
    """The survey's rows, stored: the answers are aggregated once, not for each
    pass of splits, fits and scores."""
    return cut_lineage(td.survey_applicants(spark, sf_dir).withColumn("label", C.target_code("target")))


def _fit(spark, sf_dir):
    """The hardened run's rows and its model: fitted once, then loaded."""
    rows = cut_lineage(stratified_split(_labeled(spark, sf_dir), "label", "id", HARDENED["test_pct"], HARDENED["val_pct"]))
    model, best = G.stored_fit(rows, HARDENED, _home(spark))
    return rows, model, best


@query("gbt_score")
def gbt_score(spark, sf_dir):
    """M5 + M6: GBT (depth 3, balanced weights, best validation prefix) scores
    and credit tier for every applicant, from 32 features."""
    rows, model, best = _fit(spark, sf_dir)
    s = G.score(model, rows, FEATURES)
    return s.select("id", "split", "label", C.r6("p").alias("p_default"),
                    C.policy_column("p", "tramo").alias("tramo"), F.lit(best).alias("trees_used"))


@query("gbt_importance")
def gbt_importance(spark, sf_dir):
    """Feature importance normalised to percent, ranked."""
    _, model, _ = _fit(spark, sf_dir)
    return G.importance(model, FEATURES, spark).select("rank", "feature", C.r6("pct").alias("pct"))


def tree_attributions(spark, sf_dir):
    rows, model, best = _fit(spark, sf_dir)
    path = TS.save_model(model.stages[-1], shared_path(spark, "gbt_trees"))
    trees = TS.trees_from_saved(spark, path)
    indexed = model.stages[0].transform(G.as_strings(rows, FEATURES))
    phi = TS.attributions(indexed, trees, [f"{f}_idx" for f in FEATURES], FEATURES, "id")
    return phi, TS.base_value(trees), G.score(model, rows, FEATURES)


@query("shap_tree")
def shap_tree(spark, sf_dir):
    """M12 (trees): path-dependent TreeSHAP shares per applicant and feature on
    the log-odds scale; base + Σ φ equals the model's logit."""
    phi, base, _ = tree_attributions(spark, sf_dir)
    return phi.select("id", "feature", C.r6("phi").alias("phi"), C.r6(F.lit(base)).alias("base_value"))


@query("audit_trees")
def audit_trees(spark, sf_dir):
    """M14 + S8: the stored pipeline (indexers and trees) of the hardened run,
    its files' digests and metrics against what is computed anew."""
    rows, model, best = _fit(spark, sf_dir)
    paths = A.store_pipeline(model, best, rows, FEATURES, shared_path(spark, "audit_trees"))
    again = stratified_split(_labeled(spark, sf_dir), "label", "id", HARDENED["test_pct"], HARDENED["val_pct"])
    out = A.audit_pipeline(again, FEATURES, paths)
    return out.select(*[C.r6(c).alias(c) if c in ("persisted_auc_test", "recomputed_auc_test", "auc_drift", "metric_drift") else c for c in out.columns])


@query("runs_gbt")
def runs_gbt(spark, sf_dir):
    """M9 (trees): the four training iterations on Spark ML GBT, recorded in the
    run registry with parameters and tags and read back in long form."""
    rows = _labeled(spark, sf_dir)
    every = {"features": [*FEATURES, *td.DEMOGRAPHIC], "runs": [{k: v for k, v in c.items()} for c in RN.GBT_CONFIGS]}
    name = G.fingerprint(rows.withColumn("split", F.lit("all")), every)
    home = shared_path(spark, "runs", unique=False)
    if not files.finished(spark, f"{home}/experiment={name}"):
        files.append_runs(RN.gbt_runs_table(rows, _home(spark)), home, name)
    runs = files.read_runs(spark, home).where(F.col("experiment") == name)
    return runs.select("run_name", F.explode(F.map_concat(
        F.transform_values("metrics", lambda _, v: v.cast("string")),
        F.transform_keys("params", lambda k, _: F.concat(F.lit("param."), k)),
        F.transform_keys("tags", lambda k, _: F.concat(F.lit("tag."), k)))).alias("name", "value"))
