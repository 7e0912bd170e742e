"""Fuzzy key reconciliation and vocabulary-gap queries.

The oracle compares every pair (brute force, fine for DuckDB on the check
scale); the Spark jobs generate candidates by rare-bigram equi-joins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import reconcile as J
from ..sources import testdata as td
from .model import labeled
from .registry import query
from .sqlparts import TRAINING, USERS, sql_list, with_

CUT = fixed.FUZZY_CUTOFF

_KEYS_SQL = """inputs AS (
  SELECT DISTINCT p_name AS input FROM part UNION SELECT DISTINCT p_name || 'x' FROM part
  UNION SELECT DISTINCT p_type FROM part),
canon AS (SELECT DISTINCT p_name AS canonical FROM part)"""


def _sim(a, b):
    return f"1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))"


def _inputs(spark, sf_dir):
    part = td.table(spark, sf_dir, "part")
    return (part.select(F.col("p_name").alias("input"))
            .unionByName(part.select(F.concat("p_name", F.lit("x")).alias("input")))
            .unionByName(part.select(F.col("p_type").alias("input"))).distinct())


@query("fuzzy_map", with_(_KEYS_SQL) + f""", rest AS (
  SELECT input FROM inputs WHERE input NOT IN (SELECT canonical FROM canon)),
best AS (
  SELECT r.input, c.canonical, {_sim('r.input', 'c.canonical')} AS sim
  FROM rest r, canon c WHERE {_sim('r.input', 'c.canonical')} >= {CUT!r}
  QUALIFY row_number() OVER (PARTITION BY r.input ORDER BY sim DESC, c.canonical) = 1)
SELECT input, input AS mapeado, 1.0::DOUBLE AS sim, 'exacto' AS tipo
FROM inputs WHERE input IN (SELECT canonical FROM canon)
UNION ALL
SELECT r.input, COALESCE(b.canonical, r.input) AS mapeado, round(b.sim, 6) AS sim,
       CASE WHEN b.canonical IS NOT NULL THEN 'difuso' ELSE 'sin_match' END AS tipo
FROM rest r LEFT JOIN best b ON r.input = b.input""")
def fuzzy_map(spark, sf_dir):
    """Normalise submitted keys to model feature names (cutoff 0.85)."""
    canonical = td.table(spark, sf_dir, "part").select(F.col("p_name").alias("canonical"))
    return J.fuzzy_map(_inputs(spark, sf_dir), canonical, CUT)


@query("fuzzy_reconcile", with_("""cols AS (SELECT DISTINCT p_name || 'x' AS columna FROM part
  UNION SELECT DISTINCT p_type FROM part),
feats AS (SELECT DISTINCT p_name AS feature FROM part UNION SELECT DISTINCT p_type FROM part)""") + f""",
need AS (SELECT feature FROM feats WHERE feature NOT IN (SELECT columna FROM cols)),
pool AS (SELECT columna FROM cols WHERE columna NOT IN (SELECT feature FROM feats)),
best AS (
  SELECT n.feature, p.columna, {_sim('n.feature', 'p.columna')} AS sim
  FROM need n, pool p WHERE {_sim('n.feature', 'p.columna')} >= {CUT!r}
  QUALIFY row_number() OVER (PARTITION BY n.feature ORDER BY sim DESC, p.columna) = 1)
SELECT feature, feature AS columna, 1.0::DOUBLE AS sim, 'exacto' AS tipo
FROM feats WHERE feature IN (SELECT columna FROM cols)
UNION ALL
SELECT n.feature, b.columna, round(b.sim, 6) AS sim, 'difuso' AS tipo
FROM need n LEFT JOIN best b ON n.feature = b.feature""")
def fuzzy_reconcile(spark, sf_dir):
    """Expected feature → export column; exact first, fail if none."""
    part = td.table(spark, sf_dir, "part")
    cols = (part.select(F.concat("p_name", F.lit("x")).alias("columna"))
            .unionByName(part.select(F.col("p_type").alias("columna"))))
    feats = (part.select(F.col("p_name").alias("feature"))
             .unionByName(part.select(F.col("p_type").alias("feature"))))
    return J.fuzzy_reconcile(cols, feats, CUT)


_VOCABS = [
    ("distrito", "users", "distrito", fixed.FORM_DISTRICTS),
    ("nivel_educativo", "users", "nivel_educativo", fixed.FORM_EDUCATION),
    ("training.distrito", "training", "distrito", fixed.TRAIN_DISTRICTS),
    ("training.nivel", "training", "nivel", fixed.TRAIN_EDUCATION),
]


@query("vocab_gaps", with_(USERS, TRAINING) + " UNION ALL ".join(
    f"SELECT '{campo}' AS campo, {col} AS valor, COUNT(*) AS n FROM {tab} "
    f"WHERE {col} IS NULL OR {col} NOT IN (SELECT unnest({sql_list(vocab)})) GROUP BY {col}"
    for campo, tab, col, vocab in _VOCABS))
def vocab_gaps(spark, sf_dir):
    """Stored values the model / form never saw, with counts."""
    frames = {"users": td.users(spark, sf_dir), "training": labeled(spark, sf_dir)}
    out = None
    for campo, tab, col, vocab in _VOCABS:
        g = J.vocab_gaps(frames[tab], col, vocab, campo)
        out = g if out is None else out.unionByName(g)
    return out
