"""Dashboard and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import report as R
from ..sources import testdata as td
from .registry import query
from .sqlparts import EVALUATIONS, LINE_PREDICTIONS, PREDICTIONS, TRAINING, USERS, policy_cols, with_

_ADMIN_SQL_ROWS = with_(USERS, EVALUATIONS, PREDICTIONS) + f"""
, joined AS (
  SELECT e.evaluacion_id, u.nombre, u.edad, u.distrito, u.nivel_educativo, e.fecha,
         strftime(e.fecha, '%Y-%m-%dT%H:%M:%S') AS fecha_registro, p.p_default,
         {policy_cols('p.p_default')}
  FROM users u JOIN evaluations e ON u.usuario_id = e.usuario_id
  JOIN predictions p ON e.evaluacion_id = p.evaluacion_id)
"""

ADMIN_LATEST_SQL = _ADMIN_SQL_ROWS + """
SELECT evaluacion_id, nombre, edad, distrito, nivel_educativo, fecha_registro, p_default,
       estado, tramo, COALESCE(monto, 0.0) AS monto
FROM joined ORDER BY fecha DESC, evaluacion_id DESC LIMIT 50"""


def _admin_rows(spark, sf_dir):
    return R.admin_rows(R.admin_join(td.users(spark, sf_dir), td.evaluations(spark, sf_dir),
                                     td.predictions(spark, sf_dir)))


@query("admin_latest", ADMIN_LATEST_SQL)
def admin_latest(spark, sf_dir):
    """J1 + G2 + W3: newest 50 evaluations with user, P(default) and tier."""
    return R.admin_latest_topk(td.users(spark, sf_dir), td.evaluations(spark, sf_dir),
                               td.predictions(spark, sf_dir), 50)


_KPI_SELECT = """
SELECT COUNT(*) AS total,
       COUNT(*) FILTER (WHERE monto > 0) AS aprobados,
       COUNT(*) FILTER (WHERE monto = 0) AS denegados,
       round(COALESCE(COUNT(*) FILTER (WHERE monto > 0) * 100.0 / NULLIF(COUNT(*), 0), 0.0), 6) AS pct_aprobados,
       round(COALESCE(COUNT(*) FILTER (WHERE monto = 0) * 100.0 / NULLIF(COUNT(*), 0), 0.0), 6) AS pct_denegados,
       round(COALESCE(AVG(p_default), 0.0), 6) AS p_promedio
"""


@query("kpi_all", _ADMIN_SQL_ROWS + _KPI_SELECT + " FROM joined")
def kpi_all(spark, sf_dir):
    """G3 over every joined evaluation (the dashboard's intent)."""
    return R.kpis(_admin_rows(spark, sf_dir))


@query("kpi_latest50", _ADMIN_SQL_ROWS + _KPI_SELECT +
       " FROM (SELECT * FROM joined ORDER BY fecha DESC, evaluacion_id DESC LIMIT 50)")
def kpi_latest50(spark, sf_dir):
    """G3 over the 50 fetched rows, as the dashboard labels them "Total"."""
    latest = R.admin_latest_topk(td.users(spark, sf_dir), td.evaluations(spark, sf_dir),
                                 td.predictions(spark, sf_dir), 50)
    return R.kpis(latest)


@query("credit_policy", with_(LINE_PREDICTIONS) + f"""
SELECT p, {policy_cols('p')}, COUNT(*) AS n FROM line_predictions GROUP BY p""")
def credit_policy(spark, sf_dir):
    """P16 on the 11 line-level probabilities (hits 0.30 exactly)."""
    lp = td.line_predictions(spark, sf_dir)
    return C.with_policy(lp, "p").groupBy("p", "estado", "tramo", "monto").agg(
        F.count(F.lit(1)).alias("n"))


@query("status_filter", _ADMIN_SQL_ROWS + """
SELECT CASE WHEN monto > 0 THEN 'aprobado' ELSE 'denegado' END AS estado_filtro,
       COUNT(*) AS n, round(SUM(monto), 6) AS monto_total
FROM joined GROUP BY 1""")
def status_filter(spark, sf_dir):
    """The approved (amount > 0) and denied (amount = 0) filters."""
    rows = _admin_rows(spark, sf_dir)
    kind = F.when(F.col("monto") > 0, F.lit("aprobado")).otherwise(F.lit("denegado"))
    return rows.groupBy(kind.alias("estado_filtro")).agg(
        F.count(F.lit(1)).alias("n"), C.r6(F.sum("monto")).alias("monto_total"))


@query("target_dist", with_(TRAINING) + """
SELECT target, COUNT(*) AS n, round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM training), 6) AS pct
FROM training GROUP BY target""")
def target_dist(spark, sf_dir):
    """G1: class counts with percent of total."""
    return R.value_counts(td.training(spark, sf_dir), "target")
