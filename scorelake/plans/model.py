"""Split, encoding, scorecard, metrics and attribution queries (M1-M7, M12, M15,
W1, W2, G8, G9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import encode, metrics, scorecard, split
from ..operators import report as R
from ..sources import testdata as td
from .modelsql import auc_select, card_ctes, confusion_cte, model_ctes, report_select, split_ctes
from .registry import query
from .sqlparts import TRAINING, policy_case, r6, with_

FEATURES = td.FEATURES
ALPHA = 1.0
TEST_PCT, VAL_PCT = 20, 25


def labeled(spark, sf_dir) -> DataFrame:
    t = td.training(spark, sf_dir)
    return t.withColumn("label", C.target_code("target"))


def split_frame(spark, sf_dir, test_pct=TEST_PCT, val_pct=VAL_PCT) -> DataFrame:
    return split.stratified_split(labeled(spark, sf_dir), "label", "id", test_pct, val_pct)


class Model:
    """The production scorecard (60/20/20 split, all features, α = 1).

    The split rows and the scorecard are cached: fitting, the per-feature
    header and each scoring join read them again, and recomputing the split's
    rank windows for every action would multiply the work (Spark ML caches
    its training input for the same reason).
    """

    def __init__(self, spark, sf_dir, features=FEATURES, alpha=ALPHA, test_pct=TEST_PCT, val_pct=VAL_PCT, training=td.training):
        self.features = list(features)
        rows = training(spark, sf_dir).withColumn("label", C.target_code("target"))
        self.rows = split.stratified_split(rows, "label", "id", test_pct, val_pct).cache()
        self.card = scorecard.fit(self.rows, self.features, "label", alpha).cache()
        self.header = scorecard.model_header(self.card)

    def release(self) -> None:
        """Drop the cached rows and card, once what was made of them is stored."""
        self.rows.unpersist()
        self.card.unpersist()

    def scored(self, df: DataFrame | None = None) -> DataFrame:
        return scorecard.score(self.rows if df is None else df, self.card, self.features, self.header)


MODEL_SQL = model_ctes(FEATURES, ALPHA, TEST_PCT, VAL_PCT)


@query("split_80_20", with_(TRAINING, *split_ctes(20, 0)) + "SELECT id, label, split FROM split")
def split_80_20(spark, sf_dir):
    """M1: stratified seeded 80/20 split."""
    return split_frame(spark, sf_dir, 20, 0).select("id", "label", "split")


@query("split_60_20_20", with_(TRAINING, *split_ctes(20, 25)) + "SELECT id, label, split FROM split")
def split_60_20_20(spark, sf_dir):
    """M2: 20 % test, then 25 % of the rest for validation."""
    return split_frame(spark, sf_dir).select("id", "label", "split")


@query("class_weights", with_(TRAINING, *split_ctes(20, 25)) + """
, c AS (SELECT label, COUNT(*) AS n FROM split WHERE split = 'train' GROUP BY label)
SELECT label, n, round((SELECT max(n) FROM c) / n, 6) AS weight FROM c""")
def class_weights(spark, sf_dir):
    """M3: balanced weights from training rows."""
    return split.class_weights(split_frame(spark, sf_dir), "label")


_ENC_LONG = " UNION ALL ".join(
    f"SELECT id, label, split, '{f}' AS feature, CAST({f} AS VARCHAR) AS level FROM split" for f in FEATURES)


@query("ordered_target_enc", with_(TRAINING, *split_ctes(20, 25)) + f"""
, long AS ({_ENC_LONG}),
prior AS (SELECT AVG(CAST(label AS DOUBLE)) AS pr FROM split WHERE split = 'train'),
tr AS (
  SELECT id, split, feature, level,
         (CAST(COALESCE(SUM(label) OVER w, 0) AS DOUBLE) + (SELECT pr FROM prior))
           / (COUNT(*) OVER w + 1) AS enc
  FROM long WHERE split = 'train'
  WINDOW w AS (PARTITION BY feature, level ORDER BY md5('42~' || CAST(id AS VARCHAR)), id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT feature, level, SUM(label) AS s, COUNT(*) AS n FROM long WHERE split = 'train' GROUP BY ALL),
rest AS (
  SELECT l.id, l.split, l.feature, l.level,
         (CAST(COALESCE(st.s, 0) AS DOUBLE) + (SELECT pr FROM prior)) / (COALESCE(st.n, 0) + 1) AS enc
  FROM long l LEFT JOIN st ON l.feature = st.feature AND l.level = st.level WHERE l.split <> 'train')
SELECT id, split, feature, level, round(enc, 6) AS enc FROM (SELECT * FROM tr UNION ALL SELECT * FROM rest)""")
def ordered_target_enc(spark, sf_dir):
    """M4 (b): leakage-free ordered target statistics per categorical level."""
    enc = encode.ordered_target_encoding(split_frame(spark, sf_dir), FEATURES, "label", "id")
    return enc.withColumn("enc", C.r6("enc"))


@query("scorecard_fit", with_(TRAINING, *split_ctes(20, 25), *card_ctes(FEATURES, ALPHA)) + """
SELECT feature, level, pos, neg, k, """ + r6("weight") + """ AS weight, """ + r6("unseen") + """ AS unseen,
       """ + r6("intercept") + """ AS intercept, """ + r6("mean_w") + """ AS mean_w FROM card""")
def scorecard_fit(spark, sf_dir):
    """M5: additive log-odds per (feature, level) from training counts."""
    card = Model(spark, sf_dir).card
    return card.select("feature", "level", "pos", "neg", "k",
                       *[C.r6(c).alias(c) for c in ("weight", "unseen", "intercept", "mean_w")])


@query("scorecard_score", MODEL_SQL + """
SELECT id, split, label, """ + r6("logit") + """ AS logit, round(p, 6) AS p_default,
       """ + policy_case("p", "tramo") + """ AS tramo
FROM scored""")
def scorecard_score(spark, sf_dir):
    """M6: P(default) and credit tier for every row."""
    s = Model(spark, sf_dir).scored()
    return s.select("id", "split", "label", C.r6("logit").alias("logit"), C.r6("p").alias("p_default"),
                    C.policy_column("p", "tramo").alias("tramo"))


@query("auc", MODEL_SQL + ", " + auc_select() + " SELECT * FROM aucs")
def auc(spark, sf_dir):
    """M7: exact ROC-AUC per split (tie-aware, bucketed running sums)."""
    return metrics.auc(Model(spark, sf_dir).scored(), "points", "label", ["split"])


@query("auc_gap", MODEL_SQL + ", " + auc_select() + """
SELECT max(auc) FILTER (WHERE split = 'train') AS auc_train,
       max(auc) FILTER (WHERE split = 'val') AS auc_validation,
       max(auc) FILTER (WHERE split = 'test') AS auc_test,
       """ + r6("max(auc) FILTER (WHERE split = 'train') - max(auc) FILTER (WHERE split = 'test')") + """
         AS train_test_gap
FROM aucs""")
def auc_gap(spark, sf_dir):
    """M7: train / validation / test AUC and the train-test gap."""
    a = metrics.auc(Model(spark, sf_dir).scored(), "points", "label", ["split"])
    pick = lambda s: F.max(F.when(F.col("split") == s, F.col("auc")))
    return a.agg(pick("train").alias("auc_train"), pick("val").alias("auc_validation"),
                 pick("test").alias("auc_test"),
                 C.r6(pick("train") - pick("test")).alias("train_test_gap"))


@query("confusion", MODEL_SQL + ", " + confusion_cte() + " SELECT * FROM cm")
def confusion(spark, sf_dir):
    """M7: confusion counts on the test split at the 0.5 class cut."""
    s = Model(spark, sf_dir).scored().filter(F.col("split") == "test")
    return metrics.confusion(s, "p", "label", 0.5)


@query("class_report", MODEL_SQL + ", " + confusion_cte() + " " + report_select())
def class_report(spark, sf_dir):
    """M7: per-class precision / recall / F1 / support, accuracy, averages."""
    s = Model(spark, sf_dir).scored().filter(F.col("split") == "test")
    return metrics.report_from_confusion(metrics.confusion(s, "p", "label", 0.5))


@query("truth_match", MODEL_SQL + """
SELECT id, label, round(p, 6) AS p_default, (p >= 0.5) = (label = 1) AS acierto
FROM scored WHERE split = 'test'""")
def truth_match(spark, sf_dir):
    """Agreement of the 0.5-cut class with the truth, test rows."""
    s = Model(spark, sf_dir).scored().filter(F.col("split") == "test")
    return s.select("id", "label", C.r6("p").alias("p_default"),
                    metrics.truth_match(s, "p", "label").alias("acierto"))


def _phi(spark, sf_dir) -> DataFrame:
    m = Model(spark, sf_dir)
    return scorecard.attributions(m.scored(), m.features, m.header, "id", keep=["split"])


_PHI_SQL = MODEL_SQL + ", phi AS (" + " UNION ALL ".join(
    f"SELECT id, split, '{f}' AS feature, CAST({f} AS VARCHAR) AS input_value, "
    f"w_{f} - (SELECT min(mean_w) FROM card WHERE feature = '{f}') AS phi FROM scored" for f in FEATURES) + ")\n"


@query("shap_linear", _PHI_SQL + f"SELECT id, split, feature, input_value, {r6('phi')} AS phi FROM phi")
def shap_linear(spark, sf_dir):
    """Per-row additive attributions (φ = term − training mean of term)."""
    return _phi(spark, sf_dir).withColumn("phi", C.r6("phi"))


def ranked_terms(scored: DataFrame, features: list[str], header: dict) -> F.Column:
    """The row's contributions as one array, largest |φ| first (ties by name):
    ranking and widths need no shuffle, as a row has all its features."""
    items = F.array(*[F.struct(
        (-F.abs(F.col(f"w_{f}") - F.lit(header[f]["mean_w"]))).alias("order"), F.lit(f).alias("feature"),
        F.col(f).cast("string").alias("input_value"), (F.col(f"w_{f}") - F.lit(header[f]["mean_w"])).alias("phi")) for f in features])
    return F.sort_array(items)


@query("topk_attr", _PHI_SQL + f"""
SELECT id, feature, input_value, {r6('phi')} AS phi, CAST(rank AS INTEGER) AS rank,
       CASE WHEN phi > 0 THEN 'up' ELSE 'down' END AS direccion
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature) AS rank FROM phi)
WHERE rank <= {fixed.TOP_FEATURES}""")
def topk_attr(spark, sf_dir):
    """The 10 largest contributions per applicant."""
    m = Model(spark, sf_dir)
    scored = m.scored()
    top = scored.select("id", F.posexplode(F.slice(ranked_terms(scored, m.features, m.header), 1, fixed.TOP_FEATURES)).alias("pos", "t"))
    return top.select("id", "t.feature", "t.input_value", C.r6("t.phi").alias("phi"), (F.col("pos") + 1).alias("rank"),
                      F.when(F.col("t.phi") > 0, F.lit("up")).otherwise(F.lit("down")).alias("direccion"))


def _importance(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


@query("global_importance", _PHI_SQL + f"""
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phi GROUP BY feature
ORDER BY avg(abs(phi)) DESC, feature LIMIT {fixed.TOP_GLOBAL}""")
def global_importance(spark, sf_dir):
    """Mean |φ| per feature, top 15 (the data behind the summary plot)."""
    imp = _importance(_phi(spark, sf_dir))
    return imp.orderBy(F.col("mean_abs_phi").desc(), "feature").limit(fixed.TOP_GLOBAL).withColumn(
        "mean_abs_phi", C.r6("mean_abs_phi"))


@query("topk_importance", _PHI_SQL + f"""
, imp AS (SELECT feature, avg(abs(phi)) AS v FROM phi GROUP BY feature)
SELECT feature, round(v, 6) AS mean_abs_phi,
       CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank,
       round(v * 100.0 / (SELECT sum(v) FROM imp), 6) AS share_pct
FROM imp ORDER BY v DESC, feature LIMIT {fixed.TOP_FEATURES}""")
def topk_importance(spark, sf_dir):
    """Global top-k importance with rank and percent of the total."""
    out = R.topk_global(_importance(_phi(spark, sf_dir)), "mean_abs_phi", "feature", fixed.TOP_FEATURES)
    return out.withColumn("mean_abs_phi", C.r6("mean_abs_phi"))


@query("attr_width", _PHI_SQL + """
SELECT id, feature, round(COALESCE(abs(phi) / NULLIF(max(abs(phi)) OVER (PARTITION BY id), 0), 0.0) * 100.0, 6)
         AS ancho
FROM phi""")
def attr_width(spark, sf_dir):
    """Bar width |φ| / max |φ| of the row × 100 (0 when all φ are 0)."""
    m = Model(spark, sf_dir)
    scored = m.scored()
    rows = scored.select("id", ranked_terms(scored, m.features, m.header).alias("t"))
    rows = rows.select("id", F.abs(F.get("t", F.lit(0))["phi"]).alias("mx"), F.inline("t"))
    return rows.select("id", "feature",
                       C.r6(F.coalesce(F.try_divide(F.abs("phi"), F.col("mx")), F.lit(0.0)) * 100.0).alias("ancho"))
