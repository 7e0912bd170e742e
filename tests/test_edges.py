"""Hand-written edge tables (FIXTURES §3) with literal expected results."""

import math

import pytest
from pyspark.sql import functions as F

from scorelake.functions import columns as C
from scorelake.functions import fixed
from scorelake.operators import metrics as M
from scorelake.operators import prepare as P
from scorelake.operators import report as R
from scorelake.operators import runs as RN
from scorelake.operators import whatif as W


#: (name, auc_train, auc_test, gap, accuracy, f1_riesgo) as published for the four iterations
PUBLISHED_RUNS = [
    ("Iter 1 Baseline", 0.9792, 0.8351, 0.1442, 0.7450, 0.5938),
    ("Iter 2 SMOTE-NC", 0.9855, 0.8190, 0.1665, 0.8060, 0.5941),
    ("Iter 3 Ablation", 0.9901, 0.8230, 0.1672, 0.8160, 0.6052),
    ("Iter 4 Hardened", 0.8844, 0.8615, 0.0229, 0.8000, 0.6454),
]


def test_policy_boundaries(spark):
    df = spark.createDataFrame([(1, 0.2999), (2, 0.30), (3, 0.3499), (4, 0.35), (5, float("nan")), (6, None)],
                               "i int, p double")
    got = [r["monto"] for r in C.with_policy(df, "p").orderBy("i").collect()]
    assert got == [800.0, 300.0, 300.0, 0.0, 0.0, 0.0]


def test_target_code(spark):
    df = spark.createDataFrame([(1, "Sí"), (2, "No"), (3, "si"), (4, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(C.target_code("t")).collect()] == [1, 0, 0, 0]


def test_first_answer_of_lists(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, [])], "i int, v array<string>")
    assert [r[0] for r in df.orderBy("i").select(P.first_value(F.col("v"))).collect()] == ["a", "a", None]


def test_malformed_json_and_null_amount(spark):
    df = spark.createDataFrame([(1, "{bad", None), (2, '{"k": 7}', 3.0)], "i int, j string, m double")
    rows = df.orderBy("i").select(C.json_or_null("j", "k INT").alias("s"),
                                  F.coalesce("m", F.lit(0.0)).alias("m")).collect()
    assert rows[0]["s"] is None and rows[0]["m"] == 0.0
    assert rows[1]["s"]["k"] == 7


def test_kpis_of_empty_table(spark):
    df = spark.createDataFrame([], "p_default double, monto double")
    r = R.kpis(df).first()
    assert r["total"] == 0 and r["p_promedio"] == 0.0 and r["pct_aprobados"] == 0.0


def test_age_validation(spark):
    df = spark.createDataFrame([(1, 14), (2, 15), (3, 80), (4, 81), (5, None)], "i int, edad int")
    df = df.select("i", F.lit("x").alias("nombre"), "edad", F.lit("d").alias("distrito"),
                   F.lit("n").alias("nivel_educativo"))
    got = [r["valido"] for r in P.validate(df).orderBy("i").collect()]
    assert got == [False, True, True, False, False]


def test_blank_name_code(spark):
    df = spark.createDataFrame([("  ", 30, "d", "n")], "nombre string, edad int, distrito string, nivel_educativo string")
    assert P.validate(df).first()["errores"] == "nombre"


def test_tier_changes_of_three_scenarios(spark):
    df = spark.createDataFrame([(1, "A", "A", "A"), (2, "A", "A", "B"), (3, "A", "B", "C")],
                               "i int, a string, b string, c string")
    got = R.tier_stability(df, ["a", "b", "c"]).orderBy("cambios").collect()
    assert [(r["cambios"], r["n"], r["marcador"]) for r in got] == [(0, 1, "estable"), (1, 1, "+1"), (2, 1, "+2")]


def test_metrics_from_published_confusion(spark):
    cm = spark.createDataFrame([(618, 132, 68, 182)], "tn long, fp long, fn long, tp long")
    rep = {r["clase"]: r for r in M.report_from_confusion(cm).collect()}
    assert rep["accuracy"]["precision"] == pytest.approx(0.8)
    assert rep["1"]["precision"] == pytest.approx(0.57962, abs=1e-5)
    assert rep["1"]["recall"] == pytest.approx(0.728)
    assert rep["1"]["f1"] == pytest.approx(0.64539, abs=1e-5)
    assert rep["1"]["support"] == 250 and rep["0"]["support"] == 750


def test_auc_all_ties_is_half(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.5, 0), (0.5, 1)], "p double, label int")
    assert M.auc(df).first()["auc"] == 0.5


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.7, 1)], "p double, label int")
    assert M.auc(df).first()["auc"] is None


def test_auc_matches_pairwise_definition(spark):
    import random
    rnd = random.Random(7)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(300)]
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "p double, label int")
    assert M.auc(df, buckets=7).first()["auc"] == pytest.approx(round(brute, 6), abs=1e-9)


def test_runs_compare_published_fixture(spark):
    rows = [(n, {"auc_test": t, "train_test_gap": g}) for n, _, t, g, _, _ in PUBLISHED_RUNS]
    runs = spark.createDataFrame(rows, "run_name string, metrics map<string,double>")
    out = {r["run_name"]: r for r in RN.compare_runs(runs, "Iter 1 Baseline", "Iter 4 Hardened").collect()}
    assert out["Iter 4 Hardened"]["reduccion_pct"] == pytest.approx(84.119279, abs=1e-6)
    assert out["Iter 4 Hardened"]["mejor_auc"] and out["Iter 4 Hardened"]["mejor_gap"]
    assert out["Iter 2 SMOTE-NC"]["delta_auc"] == pytest.approx(-0.0161)


def test_strip_prefix_greedy_and_plain(spark):
    pre = fixed.LIKERT_PREFIX
    df = spark.createDataFrame([(1, f"{pre} [a] [c]"), (2, "  plain  "), (3, f"{pre}   [b]  ")], "i int, h string")
    got = df.orderBy("i").select(C.strip_likert_prefix("h").alias("s"), C.first_bracket("h").alias("f")).collect()
    assert [r["s"] for r in got] == ["a] [c", "plain", "b"]
    assert [r["f"] for r in got] == ["a", None, "b"]


def test_label_clean_and_truncate(spark):
    df = spark.createDataFrame([(1, "x [Pregunta] y"), (2, fixed.PAYMENT_QUESTION), (3, "DISTRITO DE RESIDENCIA"),
                                (4, "NIVEL EDUCATIVO"), (5, "Marca temporal")], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(C.label_clean("h")).collect()]
    assert got == ["Pregunta", fixed.LABEL_PAYMENT, fixed.LABEL_DISTRICT, fixed.LABEL_EDUCATION, "Marca temporal"]
    t = spark.createDataFrame([("a" * 68,), ("a" * 69,)], "s string")
    assert [r[0] for r in t.select(C.truncate("s", 68, 65)).collect()] == ["a" * 68, "a" * 65 + "..."]


def test_to_level_half_even(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5), (3, 0.2), (4, 9.0)], "i int, v double")
    got = df.orderBy("i").select(C.to_level_index("v").alias("l"), C.level_name(C.to_level_index("v")).alias("n")).collect()
    assert [r["l"] for r in got] == [2, 4, 1, 5]
    assert got[3]["n"] == fixed.LIKERT_LEVELS[4]


def test_money_text(spark):
    df = spark.createDataFrame([(1, 1234.5), (2, 0.0)], "i int, m double")
    assert [r[0] for r in df.orderBy("i").select(C.fmt_money("m")).collect()] == ["S/ 1,234.50", "—"]


def test_missing_features_and_column_about(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    with pytest.raises(ValueError, match="z"):
        P.align(df, ["x", "z"])
    assert P.column_about(df.withColumnRenamed("x", fixed.PAYMENT_QUESTION), fixed.PAYMENT_FRAGMENT) == fixed.PAYMENT_QUESTION
    with pytest.raises(ValueError):
        P.column_about(df, "nothing")
    assert P.string_columns(df) == ["x"]


def test_perturbation_always_changes_level(spark):
    rows = [(a, f"q{i:02d}", (a + i) % 5 + 1) for a in range(20) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "applicant long, item string, level int")
    p = W.perturb(df).filter("cambiado")
    assert p.filter(F.col("level") == F.col("nivel_original")).count() == 0
    per = {(r["applicant"], r["n"]): r["c"] for r in p.groupBy("applicant", "n").agg(F.count("*").alias("c")).collect()}
    assert all(per[(a, n)] == n for a in range(20) for n in fixed.PERTURBATION_COUNTS)
