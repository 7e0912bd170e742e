"""Oversampling queries (M8): VDM table (value check), SMOTEN and SMOTE-NC
synthetic rows (rows-only; invariants in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import resample as RS
from ..operators.split import stratified_split
from ..session import cut_lineage
from ..sources import testdata as td
from .model import split_frame
from .modelsql import split_ctes
from .registry import query
from .sqlparts import TRAINING, with_

NOMINAL = ["distrito", "nivel", "tamano"]


def _train(spark, sf_dir):
    return split_frame(spark, sf_dir, 20, 0).filter(F.col("split") == "train")


@query("vdm_table", with_(TRAINING, *split_ctes(20, 0)) + """, train AS (SELECT * FROM split WHERE split = 'train'),
long AS (""" + " UNION ALL ".join(
    f"SELECT label, '{f}' AS feature, CAST({f} AS VARCHAR) AS level FROM train" for f in NOMINAL) + """)
SELECT feature, level, COUNT(*) AS n, COUNT(*) FILTER (WHERE label = 1) AS n_pos,
       round(COUNT(*) FILTER (WHERE label = 1) / COUNT(*), 6) AS share_pos,
       round((COUNT(*) - COUNT(*) FILTER (WHERE label = 1)) / COUNT(*), 6) AS share_neg
FROM long GROUP BY feature, level""")
def vdm_table(spark, sf_dir):
    """M8: per-level class shares — the SMOTEN value-difference metric."""
    return RS.vdm_table(_train(spark, sf_dir), NOMINAL)


def _survey(spark, sf_dir):
    """The training rows, stored: the answers are aggregated once, not for each
    of the split's and the oversampling's passes."""
    rows = cut_lineage(td.survey_applicants(spark, sf_dir).withColumn("label", C.target_code("target")))
    return cut_lineage(stratified_split(rows, "label", "id", 20, 0).filter(F.col("split") == "train"))


@query("smoten")
def smoten(spark, sf_dir):
    """M8: SMOTEN on the 80 % training rows of the survey, 32 nominal features."""
    return RS.oversample(_survey(spark, sf_dir), td.SURVEY_FEATURES, [], "label", 5)


@query("smote_nc")
def smote_nc(spark, sf_dir):
    """M8: SMOTE-NC on the survey: 33 nominal features, ``edad`` interpolated."""
    rows = _survey(spark, sf_dir).withColumn("edad", F.col("edad").cast("double"))
    out = RS.oversample(rows, [*td.SURVEY_FEATURES, "situacion"], ["edad"], "label", 5)
    return out.withColumn("edad", C.r6("edad"))
