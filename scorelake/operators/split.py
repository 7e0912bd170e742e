"""Stratified seeded splits and balanced class weights (M1-M3).

Rows are ordered inside each class by ``md5(seed~id)`` then id; the first
``⌊test%·n⌋`` are test, the next ``⌊val%·(n − test)⌋`` validation, the rest
train.  Integer percent arithmetic keeps the cut exact in every engine.
Positions come from :func:`ordered.ordered_position` (no one-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ordered import order_key, ordered_position


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id",
                     test_pct: int = 20, val_pct: int = 0, seed: int = fixed.RANDOM_SEED) -> DataFrame:
    """Add ``split`` ∈ {test, val, train}; ``val_pct`` is a percent of the rest."""
    pos = ordered_position(df, [label], order_key(seed, id_col), id_col)
    n_test = F.expr(f"_group_n * {int(test_pct)} div 100")
    n_val = F.expr(f"(_group_n - _group_n * {int(test_pct)} div 100) * {int(val_pct)} div 100")
    split = (F.when(F.col("_pos") < n_test, F.lit("test"))
             .when(F.col("_pos") < n_test + n_val, F.lit("val"))
             .otherwise(F.lit("train")))
    return pos.withColumn("split", split).drop("_pos", "_group_n")


def class_weights(df: DataFrame, label: str = "label", split: str | None = "train") -> DataFrame:
    """Balanced weights from training rows: max class count / class count."""
    rows = df if split is None else df.filter(F.col("split") == split)
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.select(F.max("n")).scalar()
    return counts.select(label, "n", F.round(top / F.col("n"), 6).alias("weight"))
