"""Experiment runs: configurations → fitted scorecards → metrics.

Each configuration is a small dict on the driver (the experiment design);
every number in a run is computed by Spark from the data.  A run is one row
``(run_name, params map, metrics map, tags map)`` appended to a parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..session import cut_lineage
from . import metrics as M
from . import scorecard as S
from .split import stratified_split

ALL_FEATURES = ["distrito", "nivel", "tamano"]

RUN_CONFIGS = [
    {"name": "Iteration_1_Baseline", "features": ALL_FEATURES, "alpha": 1.0, "test_pct": 20, "val_pct": 0,
     "oversample": False, "tags": {"oversampling": "None", "ablation": "No", "split_strategy": "80/20"}},
    {"name": "Iteration_2_Oversampled", "features": ALL_FEATURES, "alpha": 1.0, "test_pct": 20, "val_pct": 0,
     "oversample": True, "tags": {"oversampling": "Random", "ablation": "No", "split_strategy": "80/20"}},
    {"name": "Iteration_3_Ablation", "features": ["nivel", "tamano"], "alpha": 1.0, "test_pct": 20,
     "val_pct": 0, "oversample": True,
     "tags": {"oversampling": "Random", "ablation": "Yes", "split_strategy": "80/20"}},
    {"name": "Iteration_4_Hardened", "features": ALL_FEATURES, "alpha": 20.0, "test_pct": 20, "val_pct": 25,
     "oversample": False, "tags": {"oversampling": "None", "ablation": "No", "split_strategy": "3-way (60/20/20)"}},
]

def run_metrics(labeled: DataFrame, cfg: dict) -> DataFrame:
    """One row of rounded metrics for one configuration.

    AUC on training rows is measured on the rows *before* oversampling, so
    the train-test gap compares like with like.  What is persisted for the
    run is released at its end.
    """
    rows = stratified_split(labeled, "label", "id", cfg["test_pct"], cfg["val_pct"]).persist()
    card = S.fit(rows, cfg["features"], "label", cfg["alpha"], oversample=cfg["oversample"]).persist()
    try:
        scored = S.score(rows, card, cfg["features"])
        return _summary(scored, "points", cfg["name"], bool(cfg["val_pct"]))
    finally:
        card.unpersist()
        rows.unpersist()


def _summary(scored: DataFrame, rank: str, name: str, validation: bool, **more) -> DataFrame:
    """One row of rounded metrics of scored rows, carried as literals: AUCs
    rank by ``rank``, classes are cut at p = 0.5 on the test rows."""
    scored = scored.persist()
    try:
        aucs = {r["split"]: r["auc"] for r in M.auc(scored, rank, "label", ["split"]).collect()}
        rep = {r["clase"]: r for r in M.report_from_confusion(M.confusion(scored.filter(F.col("split") == "test"))).collect()}
    finally:
        scored.unpersist()
    gap = None if None in (aucs.get("train"), aucs.get("test")) else round(aucs["train"] - aucs["test"], 6) + 0.0
    row = {"run_name": name, "accuracy_test": rep["accuracy"]["precision"], "auc_train": aucs.get("train"), "auc_test": aucs.get("test"),
           "train_test_gap": gap, "precision_viable": rep["0"]["precision"], "recall_viable": rep["0"]["recall"], "f1_viable": rep["0"]["f1"],
           "precision_riesgo": rep["1"]["precision"], "recall_riesgo": rep["1"]["recall"], "f1_riesgo": rep["1"]["f1"]}
    if validation:
        row["auc_validation"] = aucs.get("val")
    row.update({k: float(v) for k, v in more.items()})
    return scored.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'run_name' else 'double'}" for k in row))


def run_record(metrics_row: DataFrame, cfg: dict) -> DataFrame:
    names = [c for c in metrics_row.columns if c != "run_name"]
    params = {k: ",".join(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v)
              for k, v in cfg.items() if k not in ("name", "tags")}
    kv = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
    return metrics_row.select(
        "run_name", kv(params).alias("params"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]).alias("metrics"),
        kv(cfg["tags"]).alias("tags"))


def runs_table(labeled: DataFrame, configs=None) -> DataFrame:
    configs = configs or RUN_CONFIGS
    out = None
    for cfg in configs:
        rec = run_record(run_metrics(labeled, cfg), cfg)
        out = rec if out is None else out.unionByName(rec)
    return out


def runs_long(runs: DataFrame) -> DataFrame:
    return runs.select("run_name", F.explode("metrics").alias("metric", "value"))


def compare_runs(runs: DataFrame, baseline: str, final: str) -> DataFrame:
    """Δ AUC vs the baseline run, best AUC / best gap flags, and the
    overfitting reduction from baseline to final.  Reference values are scalar
    subqueries (one row each), not a cross join."""
    r = runs.select("run_name", F.col("metrics")["auc_test"].alias("auc_test"),
                    F.col("metrics")["train_test_gap"].alias("gap"))
    base = r.filter(F.col("run_name") == baseline)
    base_auc = base.select("auc_test").scalar()
    base_gap = base.select("gap").scalar()
    final_gap = r.filter(F.col("run_name") == final).select("gap").scalar()
    best_auc = r.select(F.max("auc_test")).scalar()
    best_gap = r.select(F.min("gap")).scalar()
    return r.select(
        "run_name", "auc_test", "gap",
        C.r6(F.col("auc_test") - base_auc).alias("delta_auc"),
        (F.col("auc_test") == best_auc).alias("mejor_auc"),
        (F.col("gap") == best_gap).alias("mejor_gap"),
        C.r6(F.try_divide((base_gap - final_gap) * F.lit(100.0), base_gap)).alias("reduccion_pct"))


SURVEY = ["distrito", "nivel", *fixed.ITEM_CODES]

#: The four training iterations on the survey, trees: every knob is in the
#: configuration and recorded with the run. Depths, minimum leaf, ablations and
#: class balance are the application's; it grows 1,000 trees, and 3,000 at step
#: 0.005 with patience 150, which as a Spark job per tree level is replaced by
#: ``TREES`` at the same or ten times the step and a patience below.
TREES, PATIENCE = 100, 20
GBT_CONFIGS = [
    {"name": "Iteration_1_Baseline", "features": [*SURVEY, "situacion", "edad"], "trees": TREES, "depth": 6, "step": 0.1, "min_instances": 1,
     "test_pct": 20, "val_pct": 0, "oversample": "none", "weights": False,
     "tags": {"oversampling": "None", "ablation": "No", "split_strategy": "80/20"}},
    {"name": "Iteration_2_Oversampled", "features": [*SURVEY, "situacion", "edad"], "trees": TREES, "depth": 4, "step": 0.05, "min_instances": 1,
     "test_pct": 20, "val_pct": 0, "oversample": "smote_nc", "weights": False,
     "tags": {"oversampling": "SMOTE-NC", "ablation": "No", "split_strategy": "80/20"}},
    {"name": "Iteration_3_Ablation", "features": SURVEY, "trees": TREES, "depth": 5, "step": 0.05, "min_instances": 1,
     "test_pct": 20, "val_pct": 0, "oversample": "smoten", "weights": False,
     "tags": {"oversampling": "SMOTEN", "ablation": "Yes", "split_strategy": "80/20"}},
    {"name": "Iteration_4_Hardened", "features": SURVEY, "trees": TREES, "patience": PATIENCE, "depth": 3, "step": 0.05, "min_instances": 25,
     "test_pct": 20, "val_pct": 25, "oversample": "none", "weights": True,
     "tags": {"oversampling": "None", "ablation": "Yes", "balancing": "Balanced", "split_strategy": "3-way (60/20/20)"}},
]


def with_synthetic(rows: DataFrame, features: list[str], kind: str, numeric: list[str], k: int = 5) -> DataFrame:
    """``rows`` (id, features, label, split) as strings plus synthetic training
    rows; a synthetic id is a hash of its origin and number."""
    from .resample import oversample

    nominal = [f for f in features if kind == "smoten" or f not in numeric]
    mixed = [f for f in features if f not in nominal]
    train = rows.filter(F.col("split") == "train").withColumns(
        {f: F.col(f).cast("string") for f in nominal} | {f: F.col(f).cast("double") for f in mixed})
    syn = oversample(train, nominal, mixed, "label", k)
    level = lambda f: (F.round(F.col(f)).cast("long") if f in mixed else F.col(f)).cast("string").alias(f)
    return rows.select("id", *[level(f) for f in features], "label", "split").unionByName(
        syn.select(F.xxhash64("origen", "j").alias("id"), *[level(f) for f in features], "label", F.lit("train").alias("split")))


def gbt_run_metrics(labeled: DataFrame, cfg: dict, base: str) -> DataFrame:
    """One configuration of trees: optional synthetic rows added to training
    (nominal, or mixed with ``edad`` as the number), optional balanced weights
    and best validation prefix; train AUC on original rows. The model is stored
    under ``base`` and loaded where it is there already."""
    from . import gbt as G

    feats = cfg["features"]
    rows = stratified_split(labeled, "label", "id", cfg["test_pct"], cfg["val_pct"]).persist()
    try:
        # stored: the fingerprint, the indexer and the trees read the synthetic rows, which are made once
        fit_rows = rows if cfg["oversample"] == "none" else cut_lineage(with_synthetic(rows, feats, cfg["oversample"], [f for f in ("edad",) if f in feats]))
        model, best = G.stored_fit(fit_rows, cfg, base)
        return _summary(G.score(model, rows, feats), "p", cfg["name"], bool(cfg["val_pct"]), trees_used=best)
    finally:
        rows.unpersist()


def gbt_runs_table(labeled: DataFrame, base: str, configs=None) -> DataFrame:
    out = None
    for cfg in configs or GBT_CONFIGS:
        rec = run_record(gbt_run_metrics(labeled, cfg, base), cfg)
        out = rec if out is None else out.unionByName(rec)
    return out
