"""Joins, dashboards and reports.

Shapes that matter at scale:
* J1 is two equi-joins; the prediction aggregate is already hash-partitioned
  on ``evaluacion_id`` so the first join reuses that exchange, and AQE turns
  either join into a broadcast when a side is measured small at runtime.
* Newest-n is ``orderBy(...).limit(n)`` → TakeOrderedAndProject: a per-task
  top-n and an n-row merge, never a global sort.
* KPIs are one hash aggregate with partial aggregation (one row per task
  crosses the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def admin_join(users: DataFrame, evaluations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Users ⋈ evaluations ⋈ predictions (inner, as in the service)."""
    return evaluations.join(predictions, "evaluacion_id").join(users, "usuario_id")


def admin_rows(joined: DataFrame) -> DataFrame:
    """G2 row shape: policy decision, amount defaulted to 0, ISO date."""
    return (
        C.with_policy(joined, "p_default")
        .withColumn("monto", F.coalesce(F.col("monto"), F.lit(0.0)))
        .withColumn("fecha_registro", C.fmt_iso("fecha"))
    )


def newest(df: DataFrame, n: int = 50, ts: str = "fecha", key: str = "evaluacion_id") -> DataFrame:
    """Newest ``n`` rows; the id breaks date ties (the service had none)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


ADMIN_COLUMNS = ["evaluacion_id", "nombre", "edad", "distrito", "nivel_educativo",
                 "fecha_registro", "p_default", "estado", "tramo", "monto"]


def admin_latest(users, evaluations, predictions, n: int = 50) -> DataFrame:
    rows = admin_rows(admin_join(users, evaluations, predictions))
    return newest(rows, n).select(*ADMIN_COLUMNS)


def kpis(rows: DataFrame, p_col: str = "p_default", amount: str = "monto") -> DataFrame:
    """Total, approved / denied counts and percents, mean p (0 if empty)."""
    total = F.count(F.lit(1))
    approved = F.count_if(F.col(amount) > 0)
    denied = F.count_if(F.col(amount) == 0)
    agg = rows.agg(
        total.alias("total"),
        approved.alias("aprobados"),
        denied.alias("denegados"),
        F.avg(p_col).alias("_mean_p"),
    )
    pct = lambda c: C.r6(F.coalesce(F.try_divide(F.col(c) * F.lit(100.0), F.col("total")), F.lit(0.0)))
    return agg.select(
        "total", "aprobados", "denegados",
        pct("aprobados").alias("pct_aprobados"),
        pct("denegados").alias("pct_denegados"),
        C.r6(F.coalesce(F.col("_mean_p"), F.lit(0.0))).alias("p_promedio"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """G1: counts with percent of total.

    The total is a scalar subquery (a partial count per task) — no window
    over the whole table and no join.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.select(col, "n", C.r6(F.col("n") * F.lit(100.0) / total).alias("pct"))


def scenario_tier_counts(cf: DataFrame, scenarios: list[str], tiers: list[str]) -> DataFrame:
    """Scenario × tier counts from the wide counterfactual table.

    Counts per scenario come from ``count_if`` columns of one aggregate, then
    an explicit ``stack`` — no pivot value discovery, one partial aggregate.
    """
    aggs = []
    for s in scenarios:
        for i, t in enumerate(tiers):
            aggs.append(F.count_if(F.col(f"tramo_{s}") == F.lit(t)).alias(f"{s}__{i}"))
    wide = cf.agg(*aggs)
    stack_args = ", ".join(
        f"'{s}', " + ", ".join(f"`{s}__{i}`" for i in range(len(tiers))) for s in scenarios)
    cols = ", ".join(f"n{i}" for i in range(len(tiers)))
    out = wide.selectExpr(f"stack({len(scenarios)}, {stack_args}) as (scenario, {cols})")
    return out


def tier_stability(cf: DataFrame, tier_cols: list[str]) -> DataFrame:
    """G5 + F10: distinct tiers per row − 1, histogram with a marker."""
    changes = F.size(F.array_distinct(F.array(*[F.col(c) for c in tier_cols]))) - 1
    return (
        cf.select(changes.alias("cambios"))
        .groupBy("cambios").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("marcador", C.stability_marker("cambios"))
    )


def topk_global(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """Global top-k with rank and share of the total.

    ``orderBy.limit`` plans as TakeOrderedAndProject; the rank window then
    runs over k rows only, and the total is a scalar subquery.
    """
    total = df.select(F.sum(value)).scalar()
    top = df.orderBy(F.col(value).desc(), F.col(key)).limit(k)
    w = Window.orderBy(F.col(value).desc(), F.col(key))
    return top.select(key, value, F.row_number().over(w).alias("rank"),
                      C.r6(F.try_divide(F.col(value) * 100.0, total)).alias("share_pct"))


def admin_latest_topk(users: DataFrame, evaluations: DataFrame, predictions: DataFrame, n: int = 50,
                      candidates: int = 200) -> DataFrame:
    """W3 + J1 without aggregating every evaluation's lines.

    Only the newest ``candidates`` evaluations (a per-task top) get their
    predictions computed: a semi-join with these few keys that Catalyst pushes
    below the prediction aggregate.  If at least ``n`` of them survive the
    inner joins, the newest ``n`` survivors are exactly the global answer -
    every other evaluation is older under the total order (date desc, id
    desc).  Otherwise the full join is the plan.  The ``n`` rows found are
    carried on, so the job runs once.
    """
    cands = newest(evaluations, candidates)
    keys = F.broadcast(cands.select("evaluacion_id"))  # at most ``candidates`` rows
    rows = admin_rows(admin_join(users, cands, predictions.join(keys, "evaluacion_id", "left_semi")))
    found = newest(rows, n).select(*ADMIN_COLUMNS)
    got = found.collect()  # at most n rows
    if len(got) < n:
        return admin_latest(users, evaluations, predictions, n)
    return users.sparkSession.createDataFrame(got, found.schema)
