"""Ordered target statistics for categorical features (M4 b).

For a training row of level v, the encoding uses only *earlier* rows of the
same level (order ``md5(seed~id)``, then id), which avoids target leakage:

    enc = (Σ label over earlier rows + prior) / (count of earlier rows + 1)

Validation and test rows use the whole training level.  A hot level is
spread over hash buckets by :func:`ordered.ordered_position`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ordered import join_null_safe, order_key, ordered_position


def long_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, level) with every level as a string — one ``inline``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level"))
                      for f in features])
    return df.select(*keep, F.inline(pairs))


def ordered_target_encoding(df: DataFrame, features: list[str], label: str = "label",
                            id_col: str = "id", seed: int = fixed.RANDOM_SEED) -> DataFrame:
    """``df`` has ``split``; returns (id, split, feature, level, enc)."""
    long = long_features(df, features, [id_col, label, "split"])
    train = long.filter(F.col("split") == "train")
    prior = df.filter(F.col("split") == "train").select(F.avg(F.col(label).cast("double"))).scalar()
    ordered = ordered_position(train, ["feature", "level"], order_key(seed, id_col), id_col, value=label)
    train_enc = ordered.select(
        id_col, "split", "feature", "level",
        ((F.col("_sum_before").cast("double") + prior) / (F.col("_pos") + F.lit(1))).alias("enc"))
    stats = train.groupBy("feature", "level").agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
    rest = (join_null_safe(long.filter(F.col("split") != "train"), stats, ["feature", "level"], "left")
            .select(id_col, "split", "feature", "level",
                    ((F.coalesce("_s", F.lit(0)).cast("double") + prior)
                     / (F.coalesce("_n", F.lit(0)) + F.lit(1))).alias("enc")))
    return train_enc.unionByName(rest)
