"""Boosted-tree invariants: attribution sums to the logit, model round trip."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from scorelake.operators import gbt as G
from scorelake.operators import treeshap as TS
from scorelake.operators.split import stratified_split
from scorelake.plans.model import FEATURES
from scorelake.plans.trees import tree_attributions
from scorelake.functions import columns as C
from scorelake.sources import testdata as td

from conftest import SF_CHECK, SF_SMALL


def worst_gap(phi, base, scored):
    logit = F.log(F.col("p") / (F.lit(1.0) - F.col("p")))
    sums = phi.groupBy("id").agg(F.sum("phi").alias("s"))
    j = scored.select("id", logit.alias("logit")).join(sums, "id", "left").fillna({"s": 0.0})
    return j.select(F.max(F.abs(F.col("s") + F.lit(base) - F.col("logit")))).first()[0]


def test_tree_shap_sums_to_logit(spark):
    phi, base, scored = tree_attributions(spark, SF_SMALL)
    assert worst_gap(phi, base, scored) < 1e-9


def test_hundreds_of_trees_over_32_features(spark, tmp_path):
    rows = stratified_split(td.survey_training(spark, SF_SMALL).withColumn("label", C.target_code("target")), "label", "id", 20, 0)
    rows = rows.select("id", *td.SURVEY_FEATURES, "label", "split").persist()
    model = G.fit(rows, td.SURVEY_FEATURES, 120, depth=3, step=0.1)
    trees = TS.trees_from_saved(spark, TS.save_model(model.stages[-1], f"file://{tmp_path}/m"))
    assert len(trees.tests) == 120
    indexed = model.stages[0].transform(G.as_strings(rows, td.SURVEY_FEATURES))
    phi = TS.attributions(indexed, trees, [f"{f}_idx" for f in td.SURVEY_FEATURES], td.SURVEY_FEATURES)
    assert phi.count() == 32 * rows.count()
    assert worst_gap(phi, TS.base_value(trees), G.score(model, rows, td.SURVEY_FEATURES)) < 1e-9


def test_gbt_pipeline_roundtrip(spark, tmp_path):
    from scorelake.plans.model import split_frame
    rows = split_frame(spark, SF_CHECK)
    model, best, losses = G.fit_best_prefix(rows, FEATURES, 5)
    assert 1 <= best <= 5 and len(losses) == 5
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    a = G.score(model, rows, FEATURES).select("id", F.col("p").alias("a"))
    b = G.score(back, rows, FEATURES).select("id", F.col("p").alias("b"))
    assert a.join(b, "id").filter(F.col("a") != F.col("b")).count() == 0
