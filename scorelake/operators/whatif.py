"""What-if jobs: counterfactual scenarios (M10) and answer perturbation (M11),
plus the questionnaire's answer scoring (J5, G6).

Counterfactuals: every row is scored under each scenario value of one
feature in the *same* row (one extra term per scenario), so there is no
explode → re-group shuffle; the scenario weights are a lookup of at most
``len(scenarios)`` scorecard rows.

Perturbation: each applicant's long answers are replicated once per
perturbation count n (a fixed list of 4), then a window partitioned by
(applicant, n) picks n items by a seeded hash.  A window group is one
applicant's answers — at most one row per item (30), whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed


# ------------------------------------------------------------------ M10
def scenario_weights(card: DataFrame, feature: str, scenarios: list[tuple[str, str]],
                     header: dict) -> dict[str, float]:
    values = [v for _, v in scenarios]
    rows = (card.filter((F.col("feature") == feature) & F.col("level").isin(values))
            .select("level", "weight").collect())
    found = {r["level"]: r["weight"] for r in rows}
    return {name: found.get(v, header[feature]["unseen"]) for name, v in scenarios}


def counterfactual(terms: DataFrame, features: list[str], header: dict, feature: str,
                   weights: dict[str, float], id_col: str = "id",
                   keep: list[str] | None = None) -> DataFrame:
    """``terms`` carries ``w_<f>`` per feature; one p and tier per scenario."""
    intercept = next(iter(header.values()))["intercept"]
    cols, tiers = [], []
    for name, w in weights.items():
        logit = F.lit(intercept)
        for f in features:
            logit = logit + (F.lit(w) if f == feature else F.col(f"w_{f}"))
        p = C.logistic(logit)
        cols += [C.r6(p).alias(f"p_{name}"), C.policy_column(p, "tramo").alias(f"tramo_{name}")]
        tiers.append(f"tramo_{name}")
    out = terms.select(id_col, *(keep or []), *cols)
    changes = F.size(F.array_distinct(F.array(*[F.col(t) for t in tiers]))) - 1
    return out.withColumn("cambios", changes)


def stability_histogram(cf: DataFrame, max_changes: int = 2) -> DataFrame:
    """Rows per number of tier changes (0..max, zeros included) + marker."""
    aggs = [F.count_if(F.col("cambios") == i).alias(f"c{i}") for i in range(max_changes + 1)]
    args = ", ".join(f"{i}, c{i}" for i in range(max_changes + 1))
    out = cf.agg(*aggs).selectExpr(f"stack({max_changes + 1}, {args}) AS (cambios, n)")
    return out.withColumn("marcador", C.stability_marker("cambios"))


# ------------------------------------------------------------------ J5, G6
def adjusted_answers(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Attach pillar / sub-dimension / reverse flag (30-row broadcast)."""
    j = answers.join(F.broadcast(items.select("item", "pillar", "subdim", "reverse")), "item")
    return j.withColumn("ajustado", F.when(F.col("reverse"), F.lit(6) - F.col("level"))
                        .otherwise(F.col("level")))


def pillar_scores(adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Mean per sub-dimension, then mean of sub-dimensions per pillar."""
    sub = adjusted.groupBy(*keys, "pillar", "subdim").agg(F.avg("ajustado").alias("_s"))
    return sub.groupBy(*keys, "pillar").agg(F.avg("_s").alias("score"))


# ------------------------------------------------------------------ M11
def perturbation_hash(seed: int, applicant: str, n: str, item: str) -> Column:
    return F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(applicant).cast("string"),
                             F.col(n).cast("string"), F.col(item)))


def perturb(answers: DataFrame, counts=None, seed: int = fixed.RANDOM_SEED) -> DataFrame:
    """Replicate per n, change n seeded-random answers to another level.

    New level = ((level − 1) + 1 + r) mod 5 + 1 with r ∈ {0..3} from the hash,
    so it always differs from the original.
    """
    counts = counts or fixed.PERTURBATION_COUNTS
    x = answers.select("applicant", "item", "level",
                       F.explode(F.array(*[F.lit(n) for n in counts])).alias("n"))
    h = perturbation_hash(seed, "applicant", "n", "item")
    w = Window.partitionBy("applicant", "n").orderBy(h, F.col("item"))
    r = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 4
    x = x.withColumn("_r", F.row_number().over(w)).withColumn("_alt", r)
    changed = F.col("_r") <= F.col("n")
    new = ((F.col("level") - 1) + 1 + F.col("_alt")) % 5 + 1
    return x.select("applicant", "n", "item", F.col("level").alias("nivel_original"),
                    F.when(changed, new).otherwise(F.col("level")).cast("int").alias("level"),
                    changed.alias("cambiado"))


def sensitivity(scored: DataFrame, weights: dict, header: dict, counts=None, seed: int = fixed.RANDOM_SEED) -> DataFrame:
    """Per (applicant, n): p of the trained scorecard, p with n answers
    changed, delta, tier change.

    An additive score moves by the changed items' weights only, so the answers
    given (at most 30) are taken from the scored row's own columns, and inside
    the row the n smallest hashes are picked for each n: no second aggregate of
    the answers, no join, no replicas.  ``scored`` has id, logit, p and a text
    column per item; unanswered items hold no level of the scale.
    """
    counts = counts or fixed.PERTURBATION_COUNTS
    given = F.filter(F.array(*[F.struct(F.lit(c).alias("item"), C.level_index(c).alias("level")) for c in fixed.ITEM_CODES]), lambda x: x["level"].isNotNull())
    rows = scored.select(F.col("id").alias("applicant"), "logit", "p", given.alias("a")).where(F.size("a") > 0)
    table = {f"{f}~{i + 1}": dict(weights[f]).get(name, header[f]["unseen"]) for f in fixed.ITEM_CODES for i, name in enumerate(fixed.LIKERT_LEVELS)}
    card = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    weight = lambda x, level: F.try_element_at(card, F.concat_ws("~", x["item"], level.cast("string")))

    def moved(n: int) -> Column:
        hashed = F.transform("a", lambda x: F.struct(
            F.md5(F.concat_ws("~", F.lit(str(seed)), F.col("applicant").cast("string"), F.lit(str(n)), x["item"])).alias("h"), x["item"].alias("item"), x["level"].alias("level")))
        def shift(x):
            alt = F.conv(F.substring(x["h"], 1, 8), 16, 10).cast("long") % 4
            return weight(x, ((x["level"] - 1) + 1 + alt) % 5 + 1) - weight(x, x["level"])
        return F.aggregate(F.slice(F.array_sort(hashed), 1, n), F.lit(0.0), lambda s, x: s + shift(x))

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), moved(n).alias("d")) for n in counts]))
    j = rows.select("applicant", F.col("p").alias("_po"), "logit", each.alias("e")).select(
        "applicant", "e.n", "_po", C.logistic(F.col("logit") + F.col("e.d")).alias("_pn"))
    t0 = C.policy_column("_po", "tramo")
    t1 = C.policy_column("_pn", "tramo")
    return j.select(
        "applicant", "n",
        C.r6("_po").alias("p_original"), C.r6("_pn").alias("p_perturbada"),
        C.r6(F.col("_pn") - F.col("_po")).alias("delta"),
        (t0 != t1).alias("tramo_cambio"), t1.alias("nuevo_tramo"))
