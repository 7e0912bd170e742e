"""Reproducibility audit of a stored scorecard.

Phases, all Spark jobs: (1) artefacts exist, with size and the SHA-256 noted
when they were stored, (2) stored metrics read back from JSON, (3) model read
back, split rebuilt from scratch, test rows rescored and AUC recomputed -
drift must stay below 1e-6, (4) smoke score of the first test rows by key (five,
or as many as there are).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources import files
from . import gbt as G
from . import metrics as M
from . import scorecard as S
from .split import stratified_split


def metrics_row(scored: DataFrame, n_terms) -> DataFrame:
    """The stored evaluation report (unrounded, as the training job writes it)."""
    aucs = {r["split"]: r["_auc"] for r in M.auc_exact(scored, "points", "label", ["split"]).collect()}
    pick = lambda s: F.lit(aucs.get(s)).cast("double")
    cm = M.confusion(scored.filter(F.col("split") == "test"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return cm.select(
        F.lit(n_terms).cast("long").alias("trees_used"),
        pick("train").alias("auc_train"), pick("val").alias("auc_validation"),
        pick("test").alias("auc_test"), (pick("train") - pick("test")).alias("train_test_gap"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision_riesgo"), rec.alias("recall_riesgo"),
        F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1_riesgo"))


def train_and_store(labeled: DataFrame, features, alpha, test_pct, val_pct, base: str) -> dict:
    """Fit, store model and metrics; returns their paths and the model's digest."""
    spark = labeled.sparkSession
    rows = stratified_split(labeled, "label", "id", test_pct, val_pct).persist()
    try:
        model_path = files.save_table_model(S.fit(rows, features, "label", alpha), f"{base}/model")
        card = spark.read.parquet(model_path)
        scored = S.score(rows, card, features).persist()
        metrics_path = files.write_json(metrics_row(scored, card.count()), f"{base}/metrics")
        scored.unpersist()
    finally:
        rows.unpersist()
    digest = files.artifact_digest(files.artifact_manifest(spark, model_path)).first()
    return {"model": model_path, "metrics": metrics_path, "model_sha256": digest["sha256"]}


AUDIT_SCHEMA = ("model_path_exists boolean, metrics_path_exists boolean, model_size_kb double, model_sha256_ok boolean, "
                "persisted_auc_test double, recomputed_auc_test double, auc_drift double, integrity_passed boolean, "
                "smoke_test_passed boolean, estado string")


def audit(labeled: DataFrame, features, paths: dict, test_pct: int, val_pct: int,
          tolerance: float = fixed.AUC_TOLERANCE) -> DataFrame:
    """One row; a lost file, a changed model or a drifting AUC fail the audit."""
    spark = labeled.sparkSession
    stored = files.artifact_digest(files.artifact_manifest(spark, paths["model"])).first()
    metrics_there = files.exists(spark, paths["metrics"])
    same = stored["existe"] and paths.get("model_sha256") in (None, stored["sha256"])
    persisted = recomputed = drift = None
    smoke = False
    if metrics_there:
        persisted = files.read_json(spark, paths["metrics"], files.METRICS_SCHEMA).first()["auc_test"]
    if stored["existe"]:
        card = files.load_table_model(spark, paths["model"]).persist()
        rebuilt = stratified_split(labeled, "label", "id", test_pct, val_pct).filter(F.col("split") == "test")
        test = S.score(rebuilt, card, features).persist()
        recomputed = M.auc_exact(test, "points", "label").first()["_auc"]
        head = test.orderBy("id").limit(fixed.SMOKE_TEST_SAMPLES).select("p").collect()
        smoke = bool(head) and all(r["p"] is not None and r["p"] == r["p"] for r in head)
        test.unpersist()
        card.unpersist()
    if persisted is not None and recomputed is not None:
        drift = abs(recomputed - persisted)
    ok = same and drift is not None and drift < tolerance
    six = lambda v: None if v is None else round(v, 6) + 0.0
    row = (stored["existe"], metrics_there, stored["size_kb"], same, six(persisted), six(recomputed), six(drift), ok, smoke,
           "PRODUCTION READY" if ok and smoke else "AUDIT FAILED")
    return spark.createDataFrame([row], AUDIT_SCHEMA)


# ---------------------------------------------------------------- a pipeline of trees
def file_table(spark, path: str) -> DataFrame:
    """(file, sha256, size_kb) of everything under a folder, ``file`` being the
    path inside it: stages, metadata and node files alike. The folder's last
    two names must not come again inside it; unreadable files are left out."""
    folder = "/" + "/".join(path.rstrip("/").split("/")[-2:]) + "/"
    return files.artifact_manifest(spark, path, True).where("existe").select(F.substring_index("path", folder, -1).alias("file"), "sha256", "size_kb")


def tree_metrics(model, rows: DataFrame, features, trees: int) -> DataFrame:
    scored = G.score(model, rows, features).persist()
    try:
        # margins in whole billionths rank as probabilities do, and carry ties exactly
        out = metrics_row(scored.withColumn("points", F.round(F.col("p") * 1e9).cast("long")), trees).collect()
    finally:
        scored.unpersist()
    return rows.sparkSession.createDataFrame(out, files.METRICS_SCHEMA)


def store_pipeline(model, trees: int, rows: DataFrame, features, base: str) -> dict:
    """Store a fitted pipeline (indexers, trees), its metrics on ``rows`` (with
    ``split``) and the digests of all its files."""
    spark = rows.sparkSession
    paths = {"model": f"{base}/model", "metrics": f"{base}/metrics", "files": f"{base}/files"}
    model.write().overwrite().save(paths["model"])
    files.write_json(tree_metrics(model, rows, features, trees).coalesce(1), paths["metrics"])  # one row: no empty file beside it
    file_table(spark, paths["model"]).write.mode("overwrite").parquet(paths["files"])
    return paths


PIPELINE_AUDIT = ("n_files long, lost long, changed long, added long, metrics_path_exists boolean, persisted_auc_test double, "
                  "recomputed_auc_test double, auc_drift double, metric_drift double, integrity_passed boolean, smoke_test_passed boolean, estado string")


def audit_pipeline(rows: DataFrame, features, paths: dict, tolerance: float = fixed.AUC_TOLERANCE) -> DataFrame:
    """One row: files of the stored pipeline that are lost, changed or added
    since it was stored, and the drift of the test AUC and of the other stored
    metrics when ``rows`` (split anew) are scored by what is stored. A pipeline
    with lost or changed files is not loaded."""
    spark = rows.sparkSession
    noted = spark.read.parquet(paths["files"]).select("file", F.col("sha256").alias("was"))
    now = file_table(spark, paths["model"]).select("file", "sha256")
    both = noted.join(now, "file", "full").agg(
        F.count("was").alias("n"), F.count_if(F.col("was").isNotNull() & F.col("sha256").isNull()).alias("lost"),
        F.count_if(F.col("was") != F.col("sha256")).alias("changed"), F.count_if(F.col("was").isNull()).alias("added")).first()
    same = both["n"] > 0 and not (both["lost"] or both["changed"] or both["added"])
    there = files.exists(spark, paths["metrics"])
    stored = files.read_json(spark, paths["metrics"], files.METRICS_SCHEMA).first().asDict() if there else {}
    fresh, smoke = {}, False
    if same:
        model = PipelineModel.load(paths["model"])
        fresh = tree_metrics(model, rows, features, model.stages[-1].getNumTrees).first().asDict()
        head = G.score(model, rows.where(F.col("split") == "test").orderBy("id").limit(fixed.SMOKE_TEST_SAMPLES), features).select("p").collect()
        smoke = bool(head) and all(r["p"] is not None and r["p"] == r["p"] for r in head)
    gaps = {k: abs(fresh[k] - stored[k]) for k in fresh if fresh[k] is not None and stored.get(k) is not None}
    gaps |= {k: float("inf") for k in fresh if (fresh[k] is None) != (stored.get(k) is None)}
    drift, most = gaps.get("auc_test"), max(gaps.values(), default=None)
    ok = same and most is not None and most < tolerance
    row = (both["n"], both["lost"], both["changed"], both["added"], there, stored.get("auc_test"), fresh.get("auc_test"), drift,
           None if most is None else float(most), ok, smoke, "PRODUCTION READY" if ok and smoke else "AUDIT FAILED")
    return spark.createDataFrame([row], PIPELINE_AUDIT)
