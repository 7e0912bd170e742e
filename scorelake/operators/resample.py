"""Minority oversampling: SMOTEN (nominal) and SMOTE-NC (mixed) (M8).

Distances.  A nominal feature f is embedded by its value-difference metric
(VDM): for two classes, Σ_c |P(c|a) − P(c|b)| = 2·|s_f(a) − s_f(b)| with
s_f(v) = P(positive | f = v) from training rows, so nominal distance is L1 in
the share space.  Numeric features are min-max scaled to [0, 1] and added to
the same L1 distance (SMOTE-NC).

Exact k nearest neighbours come from ``neighbours.knn``, over any number of
features: minority rows collapse to distinct *profiles* with a count (a profile
holding a third of the rows is one record), cells around pivots are cut into
blocks, and pivot distances decide which blocks a profile has to visit.

Synthetic rows: N_majority − N_minority of them, spread over minority rows in
seeded-hash order (q or q+1 each).  SMOTEN: every feature is the mode of the k
neighbours (ties to the smallest value).  SMOTE-NC: numeric = x + u·(n − x)
for a hashed neighbour n and hashed u ∈ [0, 1); nominal = mode of the k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut_lineage, sized_broadcast
from .neighbours import knn
from .ordered import order_key
from .scorecard import IN_ROW_LEVELS, weight_of


def vdm_table(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per (feature, level): rows, positives and class shares (train rows)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level"))
                      for f in features])
    long = rows.select(label, F.inline(pairs))
    agg = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"),
                                               F.count_if(F.col(label) == 1).alias("n_pos"))
    return agg.select("feature", "level", "n", "n_pos",
                      F.round(F.col("n_pos") / F.col("n"), 6).alias("share_pos"),
                      F.round((F.col("n") - F.col("n_pos")) / F.col("n"), 6).alias("share_neg"))


def _embed(rows: DataFrame, minority: DataFrame, nominal: list[str], numeric: list[str], label: str, value: int) -> DataFrame:
    """Distinct minority profiles with count and embedding ``vec``.

    Shares of levels come from one aggregate over the long form; a feature of
    few levels is looked up in the row, another joins its shares.
    """
    prof = minority.groupBy(*nominal, *numeric).agg(F.count(F.lit(1)).alias("c"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in nominal])
    shares = cut_lineage(rows.select(label, F.inline(pairs)).groupBy("feature", "level").agg(
        (F.count_if(F.col(label) == value) / F.count(F.lit(1))).alias("share"))) if nominal else None
    levels = {r["feature"]: r["n"] for r in shares.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()} if nominal else {}
    small = [f for f in nominal if levels.get(f, 0) <= IN_ROW_LEVELS]
    known: dict[str, list] = {f: [] for f in small}
    for r in (shares.where(F.col("feature").isin(small)).collect() if small else []):  # IN_ROW_LEVELS a feature at most
        known[r["feature"]].append((r["level"], r["share"]))
    coords = {f: weight_of(F.col(f).cast("string"), known[f], 0.0) for f in small}
    for f in (f for f in nominal if f not in small):
        own = shares.where(F.col("feature") == f).select(F.col("level").alias(f"_l_{f}"), F.col("share").alias(f"_s_{f}"))
        prof = prof.join(sized_broadcast(own), F.col(f).cast("string").eqNullSafe(F.col(f"_l_{f}")), "left").drop(f"_l_{f}")
        coords[f] = F.coalesce(F.col(f"_s_{f}"), F.lit(0.0))
    if numeric:
        spans = rows.agg(*[x for f in numeric for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))]).first()
        for f in numeric:
            lo, hi = float(spans[f"lo_{f}"]), float(spans[f"hi_{f}"])
            coords[f] = (F.col(f).cast("double") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
    vec = F.array(*[coords[f].cast("double") for f in [*nominal, *numeric]])
    return prof.select(profile_id([*nominal, *numeric]).alias("pid"), "c", vec.alias("vec"), *nominal, *numeric)


def profile_id(columns: list[str]):
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}))


#: Hex digits of the hash order that choose between whole buckets.
DIGITS = 3


def _assignments(minority: DataFrame, n_new: int, n_min: int, seed: int, id_col: str) -> DataFrame:
    """Synthetic count per minority row: q or q + 1 in seeded-hash order.

    Rows per hash bucket (16 ** DIGITS at most) tell in which bucket the first
    ``extra`` rows end; only that bucket's rows are ranked.
    """
    q, extra = divmod(n_new, n_min) if n_min else (0, 0)
    rows = minority.withColumn("_key", order_key(seed, id_col, "smote")).withColumn("_b", F.substring("_key", 1, DIGITS))
    cut, before = None, 0
    for r in sorted(rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_b"]):
        if before + r["n"] > extra:
            cut = r["_b"]
            break
        before += r["n"]
    if cut is None:
        more = rows.withColumn("_more", F.lit(1 if extra else 0))
    else:
        place = F.row_number().over(Window.partitionBy("_b").orderBy("_key", id_col))
        inside = rows.where(F.col("_b") == cut).withColumn("_more", (place <= extra - before).cast("int"))
        more = rows.where(F.col("_b") != cut).withColumn("_more", (F.col("_b") < cut).cast("int")).unionByName(inside)
    return more.withColumn("_q", F.lit(q) + F.col("_more")).where("_q > 0").drop("_key", "_b", "_more")


def _modes(found: DataFrame, prof: DataFrame, nominal: list[str]) -> DataFrame:
    """Per profile: the weighted mode of each nominal feature among its k rows
    (ties to the smallest value). A profile has k neighbours at most, so the
    modes of all features are found in one aggregate and in the row."""
    vals = found.join(prof.select(F.col("pid").alias("nid"), *nominal), "nid")
    lists = vals.groupBy("pid").agg(F.collect_list(F.struct("w", *nominal)).alias("near"))

    def mode(f: str):
        levels = F.array_distinct(F.transform("near", lambda x: x[f]))
        weight = lambda v: F.aggregate("near", F.lit(0).cast("long"), lambda s, x: s + F.when(x[f].eqNullSafe(v), x["w"]).otherwise(F.lit(0).cast("long")))
        return F.array_min(F.transform(levels, lambda v: F.struct((-weight(v)).alias("n"), v.alias("v"))))["v"]

    return lists.select("pid", *[mode(f).alias(f"_m_{f}") for f in nominal])


def oversample(rows: DataFrame, nominal: list[str], numeric: list[str], label: str = "label",
               k: int = 5, seed: int = fixed.RANDOM_SEED, id_col: str = "id") -> DataFrame:
    """Synthetic rows of the smaller class, so that both classes are equal."""
    tot = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    value = int(tot["p"] <= tot["n"])
    n_min, n_maj = sorted((int(tot["p"]), int(tot["n"])))
    minority = rows.filter((F.col(label) == 1) == F.lit(bool(value)))
    prof = cut_lineage(_embed(rows, minority, nominal, numeric, label, value))
    found = cut_lineage(knn(prof, k))
    modes = _modes(found, prof, nominal) if nominal else None
    base = _assignments(minority, n_min and n_maj - n_min, n_min, seed, id_col).withColumn("pid", profile_id([*nominal, *numeric]))
    syn = base.select(id_col, "pid", *nominal, *numeric, F.explode(F.sequence(F.lit(1), F.col("_q"))).alias("j"))
    if modes is not None:
        syn = syn.join(modes, "pid", "left")
    if numeric:
        # neighbour m ∈ [0, k) by hash, located in the weighted neighbour list
        h = F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("j").cast("string")))
        held = found.groupBy("pid").agg(F.sum("w").alias("_rows"))  # fewer than k where there are fewer rows
        syn = syn.join(held, "pid", "left").withColumn("_m", F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.col("_rows")).withColumn(
            "_u", F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / F.lit(float(16 ** 8)))
        nb = found.withColumn("_lo", F.coalesce(F.sum("w").over(
            Window.partitionBy("pid").orderBy("dist", "nid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        nb = nb.join(prof.select(F.col("pid").alias("nid"), *[F.col(f).alias(f"_n_{f}") for f in numeric]), "nid").withColumnRenamed("pid", "_p")
        syn = syn.join(nb, (F.col("pid") == F.col("_p")) & (F.col("_m") >= F.col("_lo")) & (F.col("_m") < F.col("_lo") + F.col("w")), "left")
        for f in numeric:  # a row without neighbours is copied
            syn = syn.withColumn(f"_v_{f}", F.coalesce(F.col(f) + F.col("_u") * (F.col(f"_n_{f}") - F.col(f)), F.col(f)))
    out = syn.select(
        F.col(id_col).alias("origen"), "j",
        *[F.coalesce(F.col(f"_m_{f}"), F.col(f)).alias(f) for f in nominal],
        *[F.col(f"_v_{f}").alias(f) for f in numeric],
        F.lit(value).alias(label))
    return out
