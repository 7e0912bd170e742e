"""Evaluation metrics as aggregates.

ROC-AUC is exact and tie-aware (Mann–Whitney):

    AUC = Σ_s pos_s · (2·neg_below_s + neg_s) / (2·P·N)

computed from per-score counts.  ``neg_below`` is a running sum, done as
(buckets at score quantiles → small running sum) + (running sum inside a
bucket), so no window ever holds the whole table.  The numerator is an
integer, so the result is identical in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import join_null_safe, quantile_bounds, range_bucket


def auc(df: DataFrame, score: str = "p", label: str = "label", by: list[str] | None = None,
        buckets: int | None = None) -> DataFrame:
    """Exact AUC per ``by`` group, rounded to 6 decimals."""
    by = by or []
    a = auc_exact(df, score, label, by, buckets)
    return a.select(*by, C.r6("_auc").alias("auc"), "n_pos", "n_neg")


def auc_exact(df: DataFrame, score: str = "p", label: str = "label", by: list[str] | None = None,
              buckets: int | None = None) -> DataFrame:
    """Unrounded AUC (``_auc``) per ``by`` group; rows without a score are left
    out.  Scores rank and tie as they are: models that must tie in any engine
    pass an integer score (``scorecard.score``'s ``points``).

    Ranges end at quantiles of the scores, so that scores bunched together
    are still spread over the tasks; the numerator is a 38-digit integer.
    """
    by = by or []
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    per = per.withColumn("_b", range_bucket(F.col(score), quantile_bounds(df, score, buckets)))
    bt = per.groupBy(*by, "_b").agg(F.sum("neg").alias("_bneg"))
    bt = bt.withColumn("_neg_before_b", F.coalesce(F.sum("_bneg").over(
        Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(*by, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_neg_in", F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    j = join_null_safe(per, bt.drop("_bneg"), [*by, "_b"])
    agg = j.groupBy(*by).agg(F.sum(pair_wins("pos", F.col("_neg_before_b") + F.col("_neg_in"), "neg")).alias("_num"),
                             F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    den = F.lit(2.0) * F.col("n_pos") * F.col("n_neg")
    return agg.select(*by, F.try_divide(F.col("_num").cast("double"), den).alias("_auc"),
                      "n_pos", "n_neg")


def pair_wins(pos: str, neg_below, neg: str):
    """Twice the pairs won (ties count once) of one score, beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return wide(F.col(pos)) * wide(F.lit(2) * neg_below + F.col(neg))


def confusion(df: DataFrame, score: str = "p", label: str = "label", cut: float = 0.5) -> DataFrame:
    pred = F.col(score) >= F.lit(cut)
    pos = F.col(label) == 1
    return df.agg(
        F.count_if(~pred & ~pos).alias("tn"), F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & pos).alias("fn"), F.count_if(pred & pos).alias("tp"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def report_from_confusion(cm: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1 = lambda p, r: F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    s1, s0 = tp + fn, tn + fp
    total = s0 + s1
    rows = F.array(
        F.struct(F.lit("0").alias("clase"), p0.alias("precision"), r0.alias("recall"),
                 f1(p0, r0).alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("clase"), p1.alias("precision"), r1.alias("recall"),
                 f1(p1, r1).alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("clase"), _ratio(tp + tn, total).alias("precision"),
                 _ratio(tp + tn, total).alias("recall"), _ratio(tp + tn, total).alias("f1"),
                 total.alias("support")),
        F.struct(F.lit("macro avg").alias("clase"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f1(p0, r0) + f1(p1, r1)) / 2).alias("f1"),
                 total.alias("support")),
        F.struct(F.lit("weighted avg").alias("clase"),
                 _ratio(p0 * s0 + p1 * s1, total).alias("precision"),
                 _ratio(r0 * s0 + r1 * s1, total).alias("recall"),
                 _ratio(f1(p0, r0) * s0 + f1(p1, r1) * s1, total).alias("f1"),
                 total.alias("support")),
    )
    out = cm.select(F.inline(rows))
    return out.select("clase", C.r6("precision").alias("precision"), C.r6("recall").alias("recall"),
                      C.r6("f1").alias("f1"), "support")


def truth_match(df: DataFrame, score: str = "p", label: str = "label", cut: float = 0.5):
    """Does the 0.5-cut class agree with the truth?"""
    return (F.col(score) >= F.lit(cut)) == (F.col(label) == 1)
