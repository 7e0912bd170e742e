"""Additive scorecard: a verifiable log-odds model (M5, M6).

Per feature f and level v, from training rows only (Laplace ``alpha``):

    w(f, v)  = ln((pos_fv + α) / (P + α·K_f)) − ln((neg_fv + α) / (N + α·K_f))
    unseen_f = ln(α / (P + α·K_f)) − ln(α / (N + α·K_f))
    logit    = ln(P / N) + Σ_f w(f, x_f),   p = 1 / (1 + e^(−logit))

Fitting is one partially aggregated ``groupBy(feature, level)`` over the long
form.  Scoring looks features of few levels up in the row; a feature with many
joins the scorecard, which is broadcast only after its row count is checked
(``sized_broadcast``); above the bound the join is a normal shuffle join.  The model is a table, so it
saves/loads as parquet and every number is reproducible in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import sized_broadcast
from .encode import long_features

CARD_COLUMNS = ["feature", "level", "pos", "neg", "k", "weight", "unseen", "intercept", "mean_w"]


def fit(df: DataFrame, features: list[str], label: str = "label", alpha: float = 1.0,
        split: str | None = "train", oversample: bool = False) -> DataFrame:
    """``oversample`` replicates every minority row ⌊majority / minority⌋
    times (exact random oversampling), which scales that class's counts."""
    rows = df if split is None else df.filter(F.col("split") == split)
    long = long_features(rows, features, [label])
    counts = long.groupBy("feature", "level").agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    # class totals: one aggregate, two numbers back to the driver
    tot = rows.agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) == 0).alias("N")).first()
    p_n, n_n = int(tot["P"]), int(tot["N"])
    if oversample and p_n and n_n:
        fp, fn = max(1, n_n // p_n), max(1, p_n // n_n)
        counts = counts.select("feature", "level", (F.col("pos") * F.lit(fp)).alias("pos"),
                               (F.col("neg") * F.lit(fn)).alias("neg"))
        p_n, n_n = p_n * fp, n_n * fn
    P, N = F.lit(p_n).cast("long"), F.lit(n_n).cast("long")
    # per-feature level count and training mean of the term: windows over the
    # small count table (one group per feature), no extra join
    per_feature = Window.partitionBy("feature")
    a = F.lit(float(alpha))
    card = counts.withColumn("k", F.count(F.lit(1)).over(per_feature))
    pk = P.cast("double") + a * F.col("k")
    nk = N.cast("double") + a * F.col("k")
    card = card.select(
        "feature", "level", "pos", "neg", "k",
        (F.log((F.col("pos").cast("double") + a) / pk)
         - F.log((F.col("neg").cast("double") + a) / nk)).alias("weight"),
        (F.log(a / pk) - F.log(a / nk)).alias("unseen"),
        F.log(F.try_divide(P, N)).alias("intercept"),
    )
    mean_w = F.try_divide(F.sum((F.col("pos") + F.col("neg")) * F.col("weight")).over(per_feature), P + N)
    return card.withColumn("mean_w", mean_w).select(*CARD_COLUMNS)


def model_header(card: DataFrame) -> dict[str, dict[str, float]]:
    """Per-feature constants (one row per feature — bounded by the schema)."""
    rows = card.groupBy("feature").agg(
        F.first("unseen").alias("unseen"), F.first("intercept").alias("intercept"),
        F.first("mean_w").alias("mean_w"), F.count(F.lit(1)).alias("k")).collect()
    return {r["feature"]: {"unseen": r["unseen"], "intercept": r["intercept"], "mean_w": r["mean_w"],
                           "k": r["k"]} for r in rows}


#: Levels of a feature that are looked up in the row; beyond it a join is made.
IN_ROW_LEVELS = 256


def in_row_weights(card: DataFrame, header: dict) -> dict[str, list[tuple[str | None, float]]]:
    """(level, weight) of the features with few levels: at most IN_ROW_LEVELS a feature."""
    small = [f for f, h in header.items() if (h.get("k") or IN_ROW_LEVELS + 1) <= IN_ROW_LEVELS]
    out: dict[str, list] = {f: [] for f in small}
    for r in card.filter(F.col("feature").isin(small)).select("feature", "level", "weight").collect():
        out[r["feature"]].append((r["level"], r["weight"]))
    return out


def weight_of(value, levels: list[tuple[str | None, float]], unseen: float):
    """A feature's weight for ``value``; a null level is a level like others."""
    pairs = [F.lit(x) for level, w in sorted((lv, w) for lv, w in levels if lv is not None) for x in (level, w)]
    known = F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("double")
    null_weight = dict(levels).get(None, unseen)
    return F.when(value.isNull(), F.lit(null_weight)).otherwise(F.coalesce(known, F.lit(unseen)))


def term_columns(df: DataFrame, card: DataFrame, features: list[str],
                 header: dict | None = None, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Add ``w_<feature>`` (the feature's log-odds term) for every row.

    Features with few levels (survey answers) are looked up in the row, without
    a join. Others join the card: by broadcast while the level count known from
    the model header is below ``max_broadcast_rows``, else by shuffle.
    """
    header = header or model_header(card)
    rows = in_row_weights(card, {f: header[f] for f in features})
    out = df.withColumns({f"w_{f}": weight_of(F.col(f).cast("string"), rows[f], header[f]["unseen"]) for f in features if f in rows})
    for f in (f for f in features if f not in rows):
        lookup = card.filter(F.col("feature") == f).select(
            F.col("level").alias(f"_lv_{f}"), F.col("weight").alias(f"_wt_{f}"), F.lit(True).alias(f"_in_{f}"))
        k = header[f].get("k")
        if k is None:
            lookup = sized_broadcast(lookup, max_broadcast_rows)
        elif k <= max_broadcast_rows:
            lookup = F.broadcast(lookup)
        out = (out.join(lookup, F.col(f).cast("string").eqNullSafe(F.col(f"_lv_{f}")) & F.col(f"_in_{f}"), "left")
               .withColumn(f"w_{f}", F.coalesce(F.col(f"_wt_{f}"), F.lit(header[f]["unseen"])))
               .drop(f"_lv_{f}", f"_wt_{f}", f"_in_{f}"))
    return out


@dataclass(frozen=True)
class Loaded:
    """A stored scorecard as constants of a plan (bounded by the schema and by
    ``IN_ROW_LEVELS`` a feature): what a stream scores with, without a join."""

    version: str
    features: list[str]
    header: dict
    weights: dict

    def score(self, df: DataFrame) -> DataFrame:
        """``score`` of a batch or streaming frame, with ``model_version``."""
        terms = {f"w_{f}": weight_of(F.col(f).cast("string"), self.weights[f], self.header[f]["unseen"]) for f in self.features}
        return _summed(df.withColumns(terms), self.features, self.header).withColumn("model_version", F.lit(self.version))


def load(card: DataFrame, version: str, features: list[str]) -> Loaded:
    """A stored card for scoring in the row; a feature that it lacks, or one of
    too many levels, is an error before any row is read."""
    header = model_header(card)
    weights = in_row_weights(card, header)
    lost = [f for f in features if f not in weights]
    if lost:
        raise ValueError(f"stored model {version} can't score features in the row: {lost}")
    return Loaded(version, list(features), header, weights)


def score(df: DataFrame, card: DataFrame, features: list[str], header: dict | None = None) -> DataFrame:
    """Add ``w_<f>``, ``logit``, ``p`` (probability of the positive class) and
    ``points``, the terms in whole billionths: rows with the same terms have
    the same points in any order of summing, so ranks and ties are exact."""
    header = header or model_header(card)
    return _summed(term_columns(df, card, features, header), features, header)


def _summed(out: DataFrame, features: list[str], header: dict) -> DataFrame:
    intercept = next(iter(header.values()))["intercept"]
    logit = F.lit(intercept)
    for f in features:
        logit = logit + F.col(f"w_{f}")
    points = sum((F.round(F.col(f"w_{f}") * F.lit(1e9)).cast("long") for f in features), F.lit(0).cast("long"))
    return out.withColumn("logit", logit).withColumn("p", C.logistic("logit")).withColumn("points", points)


def attributions(scored: DataFrame, features: list[str], header: dict, id_col: str = "id",
                 keep: list[str] | None = None) -> DataFrame:
    """M12 for the additive model: φ_f = w_f − E_train[w_f]; long output.

    base = intercept + Σ E[w_f]; base + Σ φ = logit for every row.
    """
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("input_value"),
                 (F.col(f"w_{f}") - F.lit(header[f]["mean_w"])).alias("phi"))
        for f in features])
    return scored.select(id_col, *(keep or []), F.inline(pairs))


def explanation(features: list[str], header: dict, k: int = 10):
    """W1 as a nested document of a scored row: the base value and the ``k``
    largest contributions, (feature, shap_value, input_value), ties by name."""
    phi = lambda f: F.col(f"w_{f}") - F.lit(header[f]["mean_w"])
    items = F.sort_array(F.array(*[F.struct((-F.round(F.abs(phi(f)), 9)).alias("order"), F.lit(f).alias("feature"), phi(f).alias("shap_value"),
                                            F.col(f).cast("string").alias("input_value")) for f in features]))
    top = F.transform(F.slice(items, 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["shap_value"].alias("shap_value"), x["input_value"].alias("input_value")))
    return F.struct(F.lit(base_value(header)).alias("base_value"), top.alias("top_features"))


def base_value(header: dict) -> float:
    intercept = next(iter(header.values()))["intercept"]
    return intercept + sum(h["mean_w"] for h in header.values())
