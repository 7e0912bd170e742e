"""Boosted trees on Spark ML (M4 a, M5, M6, M13, S8).

* categories: ``StringIndexer(handleInvalid="keep")`` — trees split on sets of
  categories and an unseen level gets its own index;
* class balance: a ``weightCol`` from balanced class weights (train rows);
* early stopping: a model is fitted, the validation log-loss of every prefix of
  trees is read with ``evaluateEachIteration``, and the best prefix before
  ``patience`` trees without improvement is cut from it; while patience has not
  run out, a model of twice the trees is fitted, up to the configured number;
* a tree is a job per level, so the rows are held in as few tasks as they need
  (``ROWS_A_TASK``), and a fit is stored under a digest of its settings and its
  rows: whoever asks for the same model again loads it;
* the boosting is checkpointed every ten trees, so its lineage stays short;
* bins: a categorical feature needs a bin per level, so the number of bins is
  the largest fitted level count.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import ensure_checkpoint_dir
from ..sources import files


def indexer(features: list[str]) -> Pipeline:
    """Category indices (alphabetical; an unseen level gets its own) and their vector."""
    idx = StringIndexer(inputCols=[f"{f}_s" for f in features], outputCols=[f"{f}_idx" for f in features],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[idx, VectorAssembler(inputCols=[f"{f}_idx" for f in features], outputCol="features")])


#: Training rows of a task: a boosting job reads all rows once per tree level.
ROWS_A_TASK = 50_000


def estimator(bins: int, max_iter: int, depth: int = 3, step: float = 0.1, min_instances: int = 1,
              seed: int = fixed.RANDOM_SEED, weight_col: str | None = "weight") -> GBTClassifier:
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxDepth=depth, maxIter=max_iter, stepSize=step,
                        minInstancesPerNode=min_instances, maxBins=max(32, bins), checkpointInterval=10, seed=seed)
    return gbt.setWeightCol(weight_col) if weight_col else gbt


def fit(rows: DataFrame, features: list[str], max_iter: int, weight_col: str | None = None, **kw) -> PipelineModel:
    """Indexer and trees on ``rows``; bins follow the largest level count."""
    ensure_checkpoint_dir(rows.sparkSession)
    data = as_strings(rows, features)
    prep = indexer(features).fit(data)
    bins = max(len(levels) for levels in prep.stages[0].labelsArray) + 1
    keep = ["label", "features", *([weight_col] if weight_col else [])]
    ready = prep.transform(data).select(*keep)
    n = ready.count()
    if 0 < n < bins:  # the learner wants as many rows as a feature has levels: all rows once more doesn't change a fit
        times = -(-bins // n)
        ready = ready.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_again")
        kw["min_instances"] = times * kw.get("min_instances", 1)
    ready = ready.repartition(max(1, -(-n // ROWS_A_TASK))).persist()
    try:
        model = estimator(bins, max_iter, weight_col=weight_col, **kw).fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[*prep.stages, model])


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` trees (boosting adds trees one by one, so a
    prefix is what fewer iterations would have given)."""
    jvm = model._java_obj
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = jvm.trees()[i], jvm.treeWeights()[i]
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(jvm.uid(), trees, weights)
    return GBTClassificationModel(cut)


def as_strings(df: DataFrame, features: list[str]) -> DataFrame:
    """Every feature as a string category (the reference casts all to str)."""
    return df.withColumns({f"{f}_s": F.col(f).cast("string") for f in features})


def with_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights from training rows, joined as a 2-row broadcast."""
    train = rows.filter(F.col("split") == "train")
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.select(F.max("_n")).scalar()
    w = counts.select(label, (top / F.col("_n")).alias("weight"))
    return rows.join(F.broadcast(w), label, "left").fillna({"weight": 1.0})


def best_prefix(losses: list[float], patience: int) -> int:
    """Trees up to the least loss, seen before ``patience`` trees without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def ran_out(losses: list[float], patience: int) -> bool:
    """``patience`` trees have gone by without a better one."""
    return len(losses) - best_prefix(losses, patience) >= patience


def fit_best_prefix(rows: DataFrame, features: list[str], max_iter: int = 30, patience: int = 150,
                    **kw) -> tuple[PipelineModel, int, list[float]]:
    """The best prefix of at most ``max_iter`` trees, its number of trees, and the
    losses that were read: no more trees are grown than twice what the stop needs."""
    data = with_weights(rows).persist()
    n = min(max_iter, patience + patience // 3 + 1)
    try:
        while True:
            model = fit(data.filter(F.col("split") == "train"), features, n, "weight", **kw)
            *prep, trees = model.stages
            val = PipelineModel(stages=prep).transform(as_strings(data.filter(F.col("split") == "val"), features))
            losses = list(trees.evaluateEachIteration(val))
            if n == max_iter or ran_out(losses, patience):
                break
            n = min(max_iter, 2 * n)
    finally:
        data.unpersist()
    best = best_prefix(losses, patience)
    if best < trees.getNumTrees:
        model = PipelineModel(stages=[*prep, first_trees(trees, best)])
    return model, best, losses


def fit_settings(cfg: dict) -> dict:
    """The learner's part of a run's configuration."""
    return {k: cfg[k] for k in ("depth", "step", "min_instances")}


def fit_run(rows: DataFrame, cfg: dict) -> tuple[PipelineModel, int]:
    """A run's model and its trees: the best validation prefix where the
    configuration has a patience, else all trees."""
    if "patience" in cfg:
        model, best, _ = fit_best_prefix(rows, cfg["features"], cfg["trees"], cfg["patience"], **fit_settings(cfg))
        return model, best
    return fit(rows.filter(F.col("split") == "train"), cfg["features"], cfg["trees"], **fit_settings(cfg)), cfg["trees"]


def fingerprint(rows: DataFrame, cfg: dict) -> str:
    """Digest of a run's settings and of the rows it is fitted on, in any order."""
    columns = ["id", *cfg["features"], "label", "split"]
    total = rows.agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    said = json.dumps([{k: v for k, v in cfg.items() if k not in ("name", "tags")}, str(total["s"]), total["n"]], sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()[:32]


def stored_fit(rows: DataFrame, cfg: dict, base: str) -> tuple[PipelineModel, int]:
    """``fit_run``, once for the same settings and rows: the model lies under
    its fingerprint, and a note that names it, written last, says it is whole.
    Each fit has a folder of its own, so two writers don't meet."""
    spark = rows.sparkSession
    home = f"{base}/fit-{fingerprint(rows, cfg)}"
    for note in files.finished_under(spark, home, "done"):
        found = spark.read.parquet(note).first()
        return PipelineModel.load(found["model"]), found["trees"]
    model, trees = fit_run(rows, cfg)
    name = uuid.uuid4().hex
    model.write().save(f"{home}/model={name}")
    spark.createDataFrame([(f"{home}/model={name}", trees)], "model string, trees int").coalesce(1).write.parquet(f"{home}/done={name}")
    return model, trees


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(as_strings(df, features))
    return out.withColumn("p", vector_to_array("probability")[1])


def importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Normalised importance in percent, with rank (model metadata: one
    value per feature, so the frame is bounded by the schema)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    imp += [0.0] * (len(features) - len(imp))  # features after the last one that is used
    total = sum(imp) or 1.0
    rows = [(f, float(v), float(v) / total * 100.0) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double, pct double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w))
