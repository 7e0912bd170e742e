"""Exact positions and running sums inside large groups, without one-task windows.

``Window.partitionBy(class).orderBy(hash)`` puts a whole class (or a hot
category level holding a third of the table) into a single task.  Instead:

1. bucket rows by a prefix of their hex order key (``16**hex_digits``
   buckets, uniform because the key is a hash);
2. count (and sum) per (group, bucket) — a small table, partially aggregated;
3. a running sum over that small table gives the rows *before* each bucket;
4. a window partitioned by (group, bucket) ranks rows inside one bucket.

Position = rows before the bucket + rank inside it; identical to the global
rank by (key, tie) because the bucket is a prefix of the key.

The bucket counts read the input a second time, pruned to the group and key
columns and partially aggregated before their (tiny) shuffle.  Feeding both
branches from one ``repartition`` was measured worse: column pruning makes the
two subtrees differ, so Spark cannot reuse the exchange and the count branch
loses its partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; ``right``'s keys go."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def quantile_bounds(df: DataFrame, col: str, buckets: int) -> list:
    """At most ``buckets - 1`` ascending bounds that cut ``col`` into ranges of
    about as many rows each (one mergeable sketch, a fixed number of values)."""
    cuts = df.agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    return sorted(set(cuts or []))


def range_bucket(col: Column, bounds: list) -> Column:
    """Number of ``bounds`` that are at most ``col``, by a doubling search."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*map(F.lit, bounds))
    steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
    inside = lambda n, b: F.coalesce(F.get(edges, n + b - 1) <= col, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda n, b: F.when(inside(n, b), n + b).otherwise(n))


def order_key(seed: int, id_col: str, salt: str | None = None) -> Column:
    """md5 of ``seed~id`` (or ``seed~salt~id``): same text in Spark and DuckDB."""
    parts = [F.lit(str(seed)), F.lit("~")]
    if salt is not None:
        parts += [F.lit(salt), F.lit("~")]
    return F.md5(F.concat(*parts, F.col(id_col).cast("string")))


def ordered_position(df: DataFrame, groups: list[str], key: Column, tie: str,
                     value: str | None = None, hex_digits: int = 5) -> DataFrame:
    """Add ``_pos`` (0-based rank in group), ``_group_n`` and, with ``value``,
    ``_sum_before`` (sum of ``value`` over strictly earlier rows)."""
    d = df.withColumn("_key", key).withColumn(
        "_b", F.conv(F.substring("_key", 1, hex_digits), 16, 10).cast("long"))
    aggs = [F.count(F.lit(1)).alias("_bn")]
    if value is not None:
        aggs.append(F.sum(value).alias("_bs"))
    buckets = d.groupBy(*groups, "_b").agg(*aggs)
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    buckets = buckets.withColumn("_cnt_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    buckets = buckets.withColumn("_group_n", F.sum("_bn").over(whole))
    if value is not None:
        buckets = buckets.withColumn("_sum_before_b", F.coalesce(F.sum("_bs").over(before), F.lit(0)))
    inner = Window.partitionBy(*groups, "_b").orderBy("_key", tie)
    d = d.withColumn("_rn", F.row_number().over(inner))
    if value is not None:
        d = d.withColumn("_sum_in", F.coalesce(
            F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = join_null_safe(d, buckets.drop("_bn", "_bs"), [*groups, "_b"])
    out = out.withColumn("_pos", F.col("_cnt_before") + F.col("_rn") - F.lit(1))
    if value is not None:
        out = out.withColumn("_sum_before", F.col("_sum_before_b") + F.col("_sum_in"))
    return out.drop("_b", "_rn", "_cnt_before", "_sum_before_b", "_sum_in", "_key")
