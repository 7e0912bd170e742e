"""What-if and questionnaire-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import scorecard
from ..operators import report as R
from ..operators import whatif as W
from ..sources import testdata as td
from .model import FEATURES, MODEL_SQL, Model
from .registry import query
from .sqlparts import ANSWERS, policy_case, r6, sql_str, values_items, with_

SCENARIO_FEATURE = "nivel"
TIERS = [rule[2] for rule in fixed.POLICY]


def _scenario_sql() -> str:
    ctes = []
    for name, value in td.SCENARIOS:
        w = (f"COALESCE((SELECT min(weight) FROM card WHERE feature = '{SCENARIO_FEATURE}' "
             f"AND level = {sql_str(value)}), (SELECT min(unseen) FROM card WHERE feature = '{SCENARIO_FEATURE}'))")
        terms = " + ".join(["(SELECT min(intercept) FROM card)"]
                           + [w if f == SCENARIO_FEATURE else f"w_{f}" for f in FEATURES])
        ctes.append(f"sc_{name} AS (SELECT id, 1.0 / (1.0 + exp(-({terms}))) AS p FROM scored)")
    cols, tiers = [], []
    for name, _ in td.SCENARIOS:
        cols.append(f"round(sc_{name}.p, 6) AS p_{name}")
        cols.append(f"{policy_case(f'sc_{name}.p', 'tramo')} AS tramo_{name}")
        tiers.append(policy_case(f"sc_{name}.p", "tramo"))
    joins = " ".join(f"JOIN sc_{n} ON sc_{n}.id = s.id" for n, _ in td.SCENARIOS)
    cf = (f"cf AS (SELECT s.id, s.split, {', '.join(cols)}, "
          f"CAST(len(list_distinct([{', '.join(tiers)}])) - 1 AS INTEGER) AS cambios "
          f"FROM scored s {joins})")
    return MODEL_SQL + ", " + ",\n".join(ctes) + ",\n" + cf + "\n"


CF_SQL = _scenario_sql()


def _counterfactual(spark, sf_dir):
    m = Model(spark, sf_dir)
    terms = scorecard.term_columns(m.rows, m.card, m.features, m.header)
    weights = W.scenario_weights(m.card, SCENARIO_FEATURE, td.SCENARIOS, m.header)
    return W.counterfactual(terms, m.features, m.header, SCENARIO_FEATURE, weights, "id", keep=["split"])


@query("counterfactual", CF_SQL + "SELECT * FROM cf")
def counterfactual(spark, sf_dir):
    """M10 + J4: three values of ``nivel`` for everyone, tiers side by side."""
    return _counterfactual(spark, sf_dir)


@query("scenario_tiers", CF_SQL + " UNION ALL ".join(
    f"SELECT '{name}' AS scenario, " + ", ".join(
        f"COUNT(*) FILTER (WHERE tramo_{name} = {sql_str(t)}) AS n{i}" for i, t in enumerate(TIERS))
    + " FROM cf" for name, _ in td.SCENARIOS))
def scenario_tiers(spark, sf_dir):
    """Scenario × tier counts (n0 = S/800, n1 = S/300, n2 = S/0)."""
    return R.scenario_tier_counts(_counterfactual(spark, sf_dir), [n for n, _ in td.SCENARIOS], TIERS)


@query("tier_stability", CF_SQL + " UNION ALL ".join(
    f"SELECT {i} AS cambios, COUNT(*) FILTER (WHERE cambios = {i}) AS n, "
    f"{sql_str('estable') if i == 0 else sql_str('+' + str(i))} AS marcador FROM cf" for i in range(3)))
def tier_stability(spark, sf_dir):
    """G5 + F10: applicants with 0, 1, 2 tier changes across scenarios."""
    return W.stability_histogram(_counterfactual(spark, sf_dir))


_ADJ_SQL = with_(ANSWERS, values_items()) + """, adj AS (
  SELECT a.applicant, a.item, a.level, i.pillar, i.subdim, i.reverse,
         CASE WHEN i.reverse THEN 6 - a.level ELSE a.level END AS ajustado
  FROM answers a JOIN items i ON a.item = i.item)
"""


@query("item_lookup", _ADJ_SQL + "SELECT * FROM adj")
def item_lookup(spark, sf_dir):
    """Every answer with its pillar, sub-dimension and reverse flag."""
    adj = W.adjusted_answers(td.answers_long(spark, sf_dir), td.items_df(spark))
    return adj.select("applicant", "item", "level", "pillar", "subdim", "reverse", "ajustado")


_PILLAR_SQL = _ADJ_SQL + """, sub AS (SELECT applicant, pillar, subdim, avg(ajustado) AS s FROM adj GROUP BY ALL),
pil AS (SELECT applicant, pillar, avg(s) AS score FROM sub GROUP BY ALL)
"""


@query("pillar_scores", _PILLAR_SQL + "SELECT applicant, pillar, round(score, 6) AS score FROM pil")
def pillar_scores(spark, sf_dir):
    """Reverse-keyed 6 − x, mean per sub-dimension, then per pillar.

    After de-duplication an applicant has at most 30 answers, so one hash
    exchange on applicant serves both aggregation levels."""
    adj = W.adjusted_answers(td.answers_long(spark, sf_dir).repartition("applicant"), td.items_df(spark))
    return W.pillar_scores(adj, ["applicant"]).withColumn("score", C.r6("score"))


def _hash_sql(n: str) -> str:
    return f"md5(concat_ws('~', '{fixed.RANDOM_SEED}', CAST(applicant AS VARCHAR), CAST({n} AS VARCHAR), item))"


_PERTURB_SQL = with_(ANSWERS, values_items()) + f""", rep AS (
  SELECT applicant, item, level, unnest({list(fixed.PERTURBATION_COUNTS)}) AS n FROM answers),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY applicant, n ORDER BY {_hash_sql('n')}, item) AS r,
         CAST(('0x' || substr({_hash_sql('n')}, 1, 8)) AS BIGINT) % 4 AS alt FROM rep),
pert AS (
  SELECT applicant, n, item, level AS nivel_original,
         CAST(CASE WHEN r <= n THEN ((level - 1) + 1 + alt) % 5 + 1 ELSE level END AS INTEGER) AS level,
         r <= n AS cambiado
  FROM ranked)
"""


@query("perturb", _PERTURB_SQL + """
SELECT applicant, n, item, nivel_original, level AS nivel_nuevo FROM pert WHERE cambiado""")
def perturb(spark, sf_dir):
    """The answers each perturbation changes, old and new level."""
    p = W.perturb(td.answers_long(spark, sf_dir))
    return p.filter("cambiado").select("applicant", "n", "item", "nivel_original",
                                       F.col("level").alias("nivel_nuevo"))
