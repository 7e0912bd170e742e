"""The scorecard at the survey's full width: district, education and 30 answers
(M5-M7, M11, M12, M15, W1, W2, G8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import metrics, scorecard
from ..operators import report as R
from ..operators import whatif as W
from ..sources import testdata as td
from .model import Model, ranked_terms
from .modelsql import auc_select, confusion_cte, model_ctes, report_select
from .registry import query
from .sqlparts import ANSWERS, level_name_sql, policy_case, r6, sql_list, with_

FEATURES = td.SURVEY_FEATURES
_Q = ", ".join(f"coalesce(max(CASE WHEN item = '{c}' THEN {level_name_sql('level')} END), 'Desconocido') AS {c}" for c in fixed.ITEM_CODES)
SURVEY = (ANSWERS, f"""training AS (
  SELECT w.*, CASE WHEN t.s * 10 >= t.n * {td.SURVEY_CUT} THEN 'Sí' ELSE 'No' END AS target
  FROM (SELECT applicant AS id, {sql_list(fixed.TRAIN_DISTRICTS)}[applicant % {len(fixed.TRAIN_DISTRICTS)} + 1] AS distrito,
               {sql_list(fixed.TRAIN_EDUCATION)}[applicant % {len(fixed.TRAIN_EDUCATION)} + 1] AS nivel, {_Q}
        FROM answers GROUP BY applicant) w
  JOIN (SELECT l_suppkey * 6 + l_orderkey % 6 AS id, SUM(CAST(round(l_discount * 100) AS BIGINT)) AS s, COUNT(*) AS n
        FROM lineitem GROUP BY 1) t USING (id))""")
MODEL_SQL = model_ctes(FEATURES, training=SURVEY).replace("\ncard AS (", "\ncard AS MATERIALIZED (").replace("\ntraining AS (", "\ntraining AS MATERIALIZED (")


def model(spark, sf_dir) -> Model:
    return Model(spark, sf_dir, FEATURES, training=td.survey_training)


@query("survey_training", with_(*SURVEY) + "SELECT * FROM training")
def survey_training(spark, sf_dir):
    """The training table: one row per applicant, 32 features and the target."""
    return td.survey_training(spark, sf_dir)


@query("survey_scorecard_fit", MODEL_SQL + f"""
SELECT feature, level, pos, neg, k, {r6('weight')} AS weight, {r6('unseen')} AS unseen,
       {r6('intercept')} AS intercept, {r6('mean_w')} AS mean_w FROM card""")
def survey_scorecard_fit(spark, sf_dir):
    """M5 over 32 features."""
    return model(spark, sf_dir).card.select("feature", "level", "pos", "neg", "k",
                                            *[C.r6(c).alias(c) for c in ("weight", "unseen", "intercept", "mean_w")])


@query("survey_score", MODEL_SQL + f"""
SELECT id, split, label, {r6('logit')} AS logit, round(p, 6) AS p_default, {policy_case('p', 'tramo')} AS tramo FROM scored""")
def survey_score(spark, sf_dir):
    """M6 over 32 features: P(default) and credit tier of every applicant."""
    s = model(spark, sf_dir).scored()
    return s.select("id", "split", "label", C.r6("logit").alias("logit"), C.r6("p").alias("p_default"), C.policy_column("p", "tramo").alias("tramo"))


@query("survey_auc", MODEL_SQL + ", " + auc_select() + " SELECT * FROM aucs")
def survey_auc(spark, sf_dir):
    """M7: ROC-AUC per split."""
    return metrics.auc(model(spark, sf_dir).scored(), "points", "label", ["split"])


@query("survey_class_report", MODEL_SQL + ", " + confusion_cte() + " " + report_select())
def survey_class_report(spark, sf_dir):
    """M7: class report of the test split."""
    s = model(spark, sf_dir).scored().filter(F.col("split") == "test")
    return metrics.report_from_confusion(metrics.confusion(s, "p", "label", 0.5))


_TERMS = ", ".join(f"{{'feature': '{f}', 'input_value': scored.{f}, 'phi': w_{f} - m.{f}}}" for f in FEATURES)
_MEANS = ", ".join(f"min(mean_w) FILTER (WHERE feature = '{f}') AS {f}" for f in FEATURES)
_PHI_SQL = MODEL_SQL + f""", means AS MATERIALIZED (SELECT {_MEANS} FROM card),
phi AS MATERIALIZED (SELECT id, t.feature, t.input_value, t.phi FROM (SELECT id, unnest([{_TERMS}]) AS t FROM scored, means m))
"""


@query("survey_topk_attr", _PHI_SQL + f"""
SELECT id, feature, input_value, {r6('phi')} AS phi, CAST(rank AS INTEGER) AS rank,
       CASE WHEN phi > 0 THEN 'up' ELSE 'down' END AS direccion
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(phi), 9) DESC, feature) AS rank FROM phi)
WHERE rank <= {fixed.TOP_FEATURES}""")
def survey_topk_attr(spark, sf_dir):
    """The 10 largest of 32 contributions per applicant."""
    m = model(spark, sf_dir)
    scored = m.scored()
    top = scored.select("id", F.posexplode(F.slice(ranked_terms(scored, m.features, m.header), 1, fixed.TOP_FEATURES)).alias("pos", "t"))
    return top.select("id", "t.feature", "t.input_value", C.r6("t.phi").alias("phi"), (F.col("pos") + 1).alias("rank"),
                      F.when(F.col("t.phi") > 0, F.lit("up")).otherwise(F.lit("down")).alias("direccion"))


def _importance(spark, sf_dir):
    m = model(spark, sf_dir)
    phi = scorecard.attributions(m.scored(), m.features, m.header, "id")
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


@query("survey_importance", _PHI_SQL + f"""
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phi GROUP BY feature
ORDER BY avg(abs(phi)) DESC, feature LIMIT {fixed.TOP_GLOBAL}""")
def survey_importance(spark, sf_dir):
    """The 15 largest mean contributions of 32."""
    top = _importance(spark, sf_dir).orderBy(F.col("mean_abs_phi").desc(), "feature").limit(fixed.TOP_GLOBAL)
    return top.withColumn("mean_abs_phi", C.r6("mean_abs_phi"))


@query("survey_topk_importance", _PHI_SQL + f"""
, imp AS (SELECT feature, avg(abs(phi)) AS v FROM phi GROUP BY feature)
SELECT feature, round(v, 6) AS mean_abs_phi, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank,
       round(v * 100.0 / (SELECT sum(v) FROM imp), 6) AS share_pct
FROM imp ORDER BY v DESC, feature LIMIT {fixed.TOP_FEATURES}""")
def survey_topk_importance(spark, sf_dir):
    """Top 10 with rank and percent of the total."""
    out = R.topk_global(_importance(spark, sf_dir), "mean_abs_phi", "feature", fixed.TOP_FEATURES)
    return out.withColumn("mean_abs_phi", C.r6("mean_abs_phi"))


def _hash_sql(n: str) -> str:
    return f"md5(concat_ws('~', '{fixed.RANDOM_SEED}', CAST(applicant AS VARCHAR), CAST({n} AS VARCHAR), item))"


def _weight_sql(level: str) -> str:
    return (f"COALESCE((SELECT min(weight) FROM card c WHERE c.feature = x.item AND c.level = {level_name_sql(level)}), "
            f"(SELECT min(unseen) FROM card c WHERE c.feature = item))")


SENSITIVITY_SQL = MODEL_SQL + f""", rep AS (
  SELECT applicant, item, level, unnest({list(fixed.PERTURBATION_COUNTS)}) AS n FROM answers),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY applicant, n ORDER BY {_hash_sql('n')}, item) AS r,
         CAST(('0x' || substr({_hash_sql('n')}, 1, 8)) AS BIGINT) % 4 AS alt FROM rep),
changed AS (SELECT applicant, n, item, level, CAST(((level - 1) + 1 + alt) % 5 + 1 AS INTEGER) AS new_level FROM ranked WHERE r <= n),
moved AS (SELECT applicant, n, SUM({_weight_sql('x.new_level')} - {_weight_sql('x.level')}) AS delta FROM changed x GROUP BY ALL),
pair AS (SELECT m.applicant, m.n, s.p AS po, 1.0 / (1.0 + exp(-(s.logit + m.delta))) AS pn FROM moved m JOIN scored s ON s.id = m.applicant)
SELECT applicant, n, round(po, 6) AS p_original, round(pn, 6) AS p_perturbada, {r6('pn - po')} AS delta,
       {policy_case('po', 'tramo')} <> {policy_case('pn', 'tramo')} AS tramo_cambio, {policy_case('pn', 'tramo')} AS nuevo_tramo
FROM pair"""


@query("sensitivity", SENSITIVITY_SQL)
def sensitivity(spark, sf_dir):
    """Every applicant rescored by the trained 32-feature card with 1, 2,
    3, 5 of the answers given changed (unanswered items keep their level)."""
    m = model(spark, sf_dir)
    return W.sensitivity(m.scored(), scorecard.in_row_weights(m.card, m.header), m.header)
