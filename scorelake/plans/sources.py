"""Source/sink round trips, experiment runs and the audit (S1-S5, S8-S10,
M9, M14, G7, P9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import audit as A
from ..operators import prepare as P
from ..operators import runs as RN
from ..operators import scorecard
from ..operators.gbt import fingerprint
from ..session import shared_path
from ..sources import files
from ..sources import testdata as td
from .model import ALPHA, FEATURES, MODEL_SQL, TEST_PCT, VAL_PCT, Model, labeled
from .modelsql import auc_select, confusion_cte, report_select, run_ctes
from .registry import query
from .sqlparts import ANSWERS, TRAINING, level_name_sql, qid, r6, sql_str, with_
from .prepare import _ALIGNED


@query("src_csv", with_(TRAINING) + "SELECT * FROM training")
def src_csv(spark, sf_dir):
    """S1 + S3: training rows written as header CSV and read back typed."""
    t = td.training(spark, sf_dir)
    return files.roundtrip_csv(t, "training", files.TRAINING_SCHEMA)


@query("src_csv_survey", _ALIGNED + "SELECT CAST(applicant AS BIGINT) AS applicant, " + ", ".join(
    f"COALESCE(CAST({qid(f)} AS VARCHAR), 'Desconocido') AS {qid(f)}" for f in P.MODEL_FEATURES)
    + " FROM renamed")
def src_csv_survey(spark, sf_dir):
    """S2 → P4/P5 → P2 → P3 → P11: the batch-respondent path from a CSV
    export with long question headers (read untyped, then normalised)."""
    export = P.respondent_export(td.answers_long(spark, sf_dir))
    raw = files.roundtrip_csv(export, "respondents")
    norm = P.drop_by_rule(P.normalize_names(raw))
    aligned = P.align(norm, P.MODEL_FEATURES, keep=["applicant"])
    out = P.fill_cast(aligned, P.MODEL_FEATURES, keep=["applicant"])
    return out.withColumn("applicant", F.col("applicant").cast("long"))


_METRICS_SQL = MODEL_SQL + ", " + auc_select() + ", " + confusion_cte() + """
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM card) AS trees_used,
       round((SELECT auc_exact FROM aucx WHERE split = 'train'), 6) AS auc_train,
       round((SELECT auc_exact FROM aucx WHERE split = 'val'), 6) AS auc_validation,
       round((SELECT auc_exact FROM aucx WHERE split = 'test'), 6) AS auc_test,
       """ + r6("(SELECT auc_exact FROM aucx WHERE split = 'train') - (SELECT auc_exact FROM aucx WHERE split = 'test')") + """ AS train_test_gap,
       round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy,
       round(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 6) AS precision_riesgo,
       round(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS recall_riesgo,
       round(COALESCE(2 * COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0)
                        * COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0)
                      / NULLIF(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0)
                               + COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 0), 0.0), 6) AS f1_riesgo
FROM cm"""


@query("src_json_metrics", _METRICS_SQL)
def src_json_metrics(spark, sf_dir):
    """The evaluation report written as JSON and read back with a schema."""
    m = Model(spark, sf_dir)
    row = A.metrics_row(m.scored(), m.card.count())
    back = files.read_json(spark, files.write_json(row, shared_path(spark, "metrics")), files.METRICS_SCHEMA)
    return back.select("trees_used", *[C.r6(c).alias(c) for c in back.columns if c != "trees_used"])


_PREFIX_OPEN = sql_str(fixed.LIKERT_PREFIX + " [")
_REQUEST_SQL = with_(ANSWERS) + f""", items_q AS (SELECT * FROM (VALUES {", ".join(
    f"('{fixed.item_code(i + 1)}', {sql_str(q[0])})" for i, q in enumerate(fixed.ITEMS))}) AS t(item, question)),
docs AS (
  SELECT a.applicant, {_PREFIX_OPEN} || q.question || ']' AS key, {level_name_sql('a.level')} AS respuesta,
         1 AS n_valores
  FROM answers a JOIN items_q q ON a.item = q.item
  UNION ALL
  SELECT applicant, {sql_str(fixed.PAYMENT_QUESTION)} AS key, CAST(NULL AS VARCHAR) AS respuesta, 0 AS n_valores
  FROM (SELECT DISTINCT applicant FROM answers))
"""


def _request_docs(spark, sf_dir):
    long = td.answers_long(spark, sf_dir)
    items = F.broadcast(td.items_df(spark).select("item", "question"))
    keyed = long.join(items, "item").select(
        "applicant", P.prefixed_header(F.col("question")).alias("key"), C.level_name("level").alias("answer"))
    export = P.respondent_export(long)
    docs = files.request_documents(keyed, export, [fixed.PAYMENT_QUESTION])
    path = files.write_json(docs, shared_path(spark, "requests"))
    return files.read_json(spark, path, files.REQUEST_SCHEMA)


@query("src_request_json", _REQUEST_SQL + """
SELECT applicant, key, respuesta, n_valores, 'Postulante ' || CAST(applicant AS VARCHAR) AS nombre,
       10 + applicant % 80 AS edad FROM docs""")
def src_request_json(spark, sf_dir):
    """Nested request documents (map of answer lists + user struct)
    written as JSON, read back with the nested schema and flattened."""
    return files.flatten_request(_request_docs(spark, sf_dir))


def _strip_sql(s: str) -> str:
    pat = fixed.LIKERT_PREFIX_PATTERN
    t = f"trim({s})"
    return f"CASE WHEN regexp_matches({t}, {sql_str(pat)}) THEN trim(regexp_extract({t}, {sql_str(pat)}, 1)) ELSE {t} END"


@query("first_answer", _REQUEST_SQL + f"""
SELECT applicant, {_strip_sql('key')} AS feature, respuesta FROM docs""")
def first_answer(spark, sf_dir):
    """P9 + P5: list-valued answers → element 0 (null for []), keys stripped."""
    flat = files.flatten_request(_request_docs(spark, sf_dir))
    return flat.select("applicant", C.strip_likert_prefix("key").alias("feature"), "respuesta")


@query("model_roundtrip", MODEL_SQL + "SELECT id, round(p, 6) AS p_default FROM scored")
def model_roundtrip(spark, sf_dir):
    """The scorecard saved as parquet, loaded back, used to score."""
    m = Model(spark, sf_dir)
    path = files.save_table_model(m.card, shared_path(spark, "model"))
    loaded = files.load_table_model(spark, path)
    s = scorecard.score(m.rows, loaded, m.features)
    return s.select("id", C.r6("p").alias("p_default"))


@query("artifact_manifest")
def artifact_manifest(spark, sf_dir):
    """Exists / size / SHA-256 of the stored model files (rows-only)."""
    m = Model(spark, sf_dir)
    path = files.save_table_model(m.card, shared_path(spark, "model"))
    return files.artifact_manifest(spark, path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("archivo"), "existe", "size_kb", "sha256")


def _run_sql() -> str:
    ctes, selects = [TRAINING], []
    for i, cfg in enumerate(RN.RUN_CONFIGS):
        pre = f"r{i}_"
        ctes += run_ctes(pre, cfg["features"], cfg["alpha"], cfg["test_pct"], cfg["val_pct"], cfg["oversample"])
        ctes.append(auc_select(f"{pre}scored", pre=pre))
        ctes.append(confusion_cte(f"{pre}scored", pre=pre))
        ctes.append(f"{pre}rep AS ({report_select(pre)})")
        auc = lambda s: f"(SELECT auc FROM {pre}aucs WHERE split = '{s}')"
        rep = lambda c, col: f"(SELECT {col} FROM {pre}rep WHERE clase = '{c}')"
        metrics = {
            "accuracy_test": rep("accuracy", "precision"), "auc_train": auc("train"), "auc_test": auc("test"),
            "train_test_gap": r6(f"{auc('train')} - {auc('test')}"),
            "precision_viable": rep("0", "precision"), "recall_viable": rep("0", "recall"),
            "f1_viable": rep("0", "f1"), "precision_riesgo": rep("1", "precision"),
            "recall_riesgo": rep("1", "recall"), "f1_riesgo": rep("1", "f1"),
        }
        if cfg["val_pct"]:
            metrics["auc_validation"] = auc("val")
        for k, v in metrics.items():
            selects.append(f"SELECT {sql_str(cfg['name'])} AS run_name, '{k}' AS metric, CAST({v} AS DOUBLE) AS value")
    return with_(*ctes) + ", runs AS (" + " UNION ALL ".join(selects) + ")\n"


RUNS_SQL = _run_sql()


def _runs(spark, sf_dir):
    """The registry's runs of this experiment, recorded if they are not there yet."""
    rows = labeled(spark, sf_dir)
    name = fingerprint(rows.withColumn("split", F.lit("all")), {"features": RN.ALL_FEATURES, "runs": RN.RUN_CONFIGS})
    home = shared_path(spark, "runs", unique=False)
    if not files.finished(spark, f"{home}/experiment={name}"):
        files.append_runs(RN.runs_table(rows), home, name)
    return files.read_runs(spark, home).where(F.col("experiment") == name)


@query("runs_log", RUNS_SQL + "SELECT * FROM runs")
def runs_log(spark, sf_dir):
    """M9 + S10: four scorecard configurations, their metrics logged as runs."""
    return RN.runs_long(_runs(spark, sf_dir))


_BASE, _FINAL = RN.RUN_CONFIGS[0]["name"], RN.RUN_CONFIGS[-1]["name"]


@query("runs_compare", RUNS_SQL + f""", r AS (
  SELECT run_name, max(value) FILTER (WHERE metric = 'auc_test') AS auc_test,
         max(value) FILTER (WHERE metric = 'train_test_gap') AS gap FROM runs GROUP BY run_name)
SELECT run_name, auc_test, gap,
       {r6(f"auc_test - (SELECT auc_test FROM r WHERE run_name = '{_BASE}')")} AS delta_auc,
       auc_test = (SELECT max(auc_test) FROM r) AS mejor_auc,
       gap = (SELECT min(gap) FROM r) AS mejor_gap,
       {r6(f"((SELECT gap FROM r WHERE run_name = '{_BASE}') - (SELECT gap FROM r WHERE run_name = '{_FINAL}')) * 100.0 / NULLIF((SELECT gap FROM r WHERE run_name = '{_BASE}'), 0)")} AS reduccion_pct
FROM r""")
def runs_compare(spark, sf_dir):
    """Δ AUC vs baseline, best AUC / gap, overfitting reduction %."""
    return RN.compare_runs(_runs(spark, sf_dir), _BASE, _FINAL)


@query("audit_report", MODEL_SQL + ", " + auc_select() + """
SELECT true AS model_path_exists, true AS metrics_path_exists, true AS model_sha256_ok, auc AS persisted_auc_test,
       auc AS recomputed_auc_test, 0.0::DOUBLE AS auc_drift, true AS integrity_passed,
       true AS smoke_test_passed, 'PRODUCTION READY' AS estado
FROM aucs WHERE split = 'test'""")
def audit_report(spark, sf_dir):
    """Store model + metrics, rebuild the split, rescore, compare AUC."""
    lab = labeled(spark, sf_dir)
    paths = A.train_and_store(lab, FEATURES, ALPHA, TEST_PCT, VAL_PCT, shared_path(spark, "audit"))
    return A.audit(lab, FEATURES, paths, TEST_PCT, VAL_PCT).drop("model_size_kb")
