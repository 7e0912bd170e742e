"""Scoring and storing of request documents: checks, last input wins, joint
commit, replays, model versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions import fixed
from scorelake.operators import reconcile as R
from scorelake.operators import scorecard
from scorelake.sources import files
from scorelake.streaming import submissions as SS

FEATURES = ["distrito", "nivel", *fixed.ITEM_CODES]
QUESTIONS = [q for q, *_ in fixed.ITEMS]


def model(version="a", weight=0.1):
    header = {f: {"unseen": -0.5, "intercept": 0.2, "mean_w": 0.05, "k": 5} for f in FEATURES}
    return scorecard.Loaded(version, FEATURES, header, {f: [(v, weight * i) for i, v in enumerate(fixed.LIKERT_LEVELS)] for f in FEATURES})


def answers(**changed):
    out = {f"{fixed.LIKERT_PREFIX} [{q}]": ["Neutral"] for q in QUESTIONS}
    out.update({k: v for k, v in changed.get("more", {}).items()})
    for k in changed.get("without", ()):
        out.pop(f"{fixed.LIKERT_PREFIX} [{k}]")
    return out


def user(**changed):
    return {"nombre": "Ana", "edad": 30, "distrito": "Ate", "nivel_educativo": "Postgrado", "situacion_laboral": "Jubilado", **changed}


def documents(spark, rows):
    return spark.createDataFrame([(i, None, d, u) for i, d, u in rows], SS.STREAM_SCHEMA).withColumn("time", F.timestamp_seconds(F.col("id")))


HEAD = lambda q: f"{fixed.LIKERT_PREFIX} [{q}]"


def test_checks_scores_and_last_input(spark):
    rows = [(1, answers(), user()), (2, answers(more={HEAD(QUESTIONS[0] + "x"): ["De acuerdo"]}), user()),
            (3, answers(more={fixed.PAYMENT_QUESTION: []}), user()), (4, answers(more={"Otra cosa": ["x"]}), user()),
            (5, answers(more={HEAD(QUESTIONS[3]): ["Neutral", "De acuerdo"]}), user()), (6, answers(without=[QUESTIONS[1]]), user()),
            (7, answers(more={HEAD(QUESTIONS[2]): ["nunca"]}), user()), (8, {}, user()), (9, None, user(edad=None)),
            (10, answers(), user(nombre=" ", edad=81, distrito=None, nivel_educativo="", situacion_laboral=None)), (11, answers(more={HEAD(QUESTIONS[4]): []}), user())]
    got = {r.id: r for r in SS.score_requests(documents(spark, rows), model()).collect()}
    assert {i: r.errores for i, r in got.items()} == {
        1: "", 2: "", 3: "", 4: "desconocida", 5: "lista", 6: "falta", 7: "respuesta", 8: "payload,falta", 9: "edad,payload,falta",
        10: "nombre,edad,distrito,nivel_educativo,situacion_laboral", 11: "falta"}
    assert got[2].respuestas.q01 == "De acuerdo" and got[1].respuestas.q01 == "Neutral"
    logit = 0.2 + 2 * -0.5 + 30 * 0.2
    assert got[1].p_default == pytest.approx(1 / (1 + math.exp(-logit))) and got[2].p_default == pytest.approx(1 / (1 + math.exp(-logit - 0.1)))
    doc = got[2].explicacion
    assert doc.base_value == pytest.approx(0.2 + 32 * 0.05) and len(doc.top_features) == 10
    assert [x.feature for x in doc.top_features[:3]] == ["distrito", "nivel", "q01"] and doc.top_features[2].shap_value == pytest.approx(0.25)
    for r in got.values():
        assert r.valido == (r.errores == "") == (r.p_default is not None) == (r.model_version == "a") == (r.estado is not None)


def test_commit_replay_and_versions(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/s"
    batch = lambda rows, m: SS.score_requests(documents(spark, rows), m)
    first = [(1, answers(), user()), (2, answers(), user()), (3, {}, user())]
    with monkeypatch.context() as m:  # the third table can't be written
        m.setitem(SS.TABLES, "predictions", ["no_such_column"])
        with pytest.raises(Exception):
            SS.write_batch(batch(first, model("a")), 0, base)
    assert files.exists(spark, f"{base}/users/batch_id=0")
    assert all(SS.read_table(spark, base, t).count() == 0 for t in ("users", "evaluations", "quarantine"))
    SS.write_batch(batch(first[:2], model("b")), 0, base)  # the replay, by a newer model; quarantine is empty now
    SS.write_batch(batch(first, model("c")), 0, base)  # committed: nothing changes
    assert {r.id: r.model_version for r in SS.read_table(spark, base, "predictions").collect()} == {1: "b", 2: "b"}
    assert SS.read_table(spark, base, "quarantine").count() == 0
    SS.write_batch(batch([(2, answers(), user()), (3, {}, user()), (3, {}, user()), (4, answers(), user())], model("c")), 1, base)
    SS.write_batch(batch([(3, answers(), user())], model("c")), 2, base)  # from quarantine, complete now
    ids = {t: sorted(r.id for r in SS.read_table(spark, base, t).collect()) for t in SS.TABLES}
    assert ids == {"users": [1, 2, 3, 4], "evaluations": [1, 2, 3, 4], "predictions": [1, 2, 3, 4], "quarantine": [3]}
    assert {r.id: r.model_version for r in SS.read_table(spark, base, "predictions").collect()} == {1: "b", 2: "b", 3: "c", 4: "c"}


def test_a_model_that_lacks_a_feature_is_refused(spark):
    card = spark.createDataFrame([("distrito", "Ate", 1.0, 1.0, 1.0, 0.1, 0.0, 0.0, 0.0)], ", ".join(f"{c} {'string' if c in ('feature', 'level') else 'double'}" for c in scorecard.CARD_COLUMNS))
    with pytest.raises(ValueError, match="nivel"):
        scorecard.load(card, "x", ["distrito", "nivel"])


def test_last_wins_on_a_table(spark):
    inputs = spark.createDataFrame([(1, 0, "abcdefgh", "a"), (1, 1, "abcdefghx", "b"), (1, 2, "zzz", "c"), (2, 5, "abcdefghx", "d"), (2, 7, "abcdefgh", None)], "id long, at int, input string, v string")
    mapping = R.fuzzy_map(inputs.select("input"), spark.createDataFrame([("abcdefgh",)], "canonical string"))
    got = {(r.id, r.feature): (r.v, r.entradas) for r in R.last_wins(inputs, "id", "at", mapping, "v").collect()}
    assert got == {(1, "abcdefgh"): ("b", 2), (1, "zzz"): ("c", 1), (2, "abcdefgh"): (None, 2)}


def test_run_registry(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    row = lambda name, v: spark.createDataFrame([(name, {"trees": v}, {"auc": 0.5}, {"t": "x"})], files.RUNS_SCHEMA)
    assert files.read_runs(spark, path).count() == 0
    for r in (row("a", "1"), row("a", "2"), row("a", "1")):
        files.append_runs(r, path)
    assert sorted(r.params["trees"] for r in files.read_runs(spark, path).collect()) == ["1", "2"]
    row("b", "9").write.mode("overwrite").parquet(f"{path}/experiment=half")
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/experiment=half/_SUCCESS"), False)
    assert files.read_runs(spark, path).count() == 2  # a writer that hasn't finished is not read
    files.append_runs(row("b", "9"), path, "half")
    assert files.read_runs(spark, path).count() == 3


def test_known_name_is_the_closest_of_all_names(spark):
    """Two-stage comparison against the plain one: every name, whole distance."""
    rnd = random.Random(3)
    names = {**SS.NAMES, "abcdefgh": "s", "abcdefgx": "t", "abcdefgh ij": "u"}
    keys = []
    for n in names:
        for edits in (0, 1, 2, 3, len(n) // 8, len(n) // 7, len(n) // 6, len(n) // 5):
            k = list(n)
            for _ in range(edits):
                at = rnd.randrange(len(k))
                k[at:at + rnd.randint(0, 1)] = rnd.choice(["", "x", "é"])
            keys.append("".join(k))
    df = spark.createDataFrame([(k,) for k in [*keys, "", "Otra cosa", "abcdefg", "abcdefghi", "abcdefgh i"]], "k string")
    every = F.array_max(F.array(*[F.struct(R.similarity(F.col("k"), F.lit(n)).alias("s"), F.lit(-i).alias("at"), F.lit(names[n]).alias("c")) for i, n in enumerate(sorted(names))]))
    got = df.select("k", R.known_name(F.col("k"), names).alias("got"), F.when(every["s"] >= fixed.FUZZY_CUTOFF, every["c"]).alias("want")).collect()
    assert [r for r in got if r.got != r.want] == [] and len({r.got for r in got}) == len(names) + 1


def test_a_key_is_cleaned_once_and_not_compared_beyond_the_cutoff(spark, monkeypatch):
    """A key was cleaned again for each use (62), and each comparison was whole."""
    limits, levenshtein = [], F.levenshtein
    monkeypatch.setattr(F, "levenshtein", lambda a, b, limit=None: limits.append(limit) or levenshtein(a, b, limit))
    rows = spark.range(1).select(R.named_entries(F.create_map(F.col("id").cast("string"), F.array(F.lit("x"))), SS.NAMES).alias("e"))
    assert len(limits) == 2 * len(SS.NAMES) and None not in limits and max(limits) < 40
    assert rows._jdf.queryExecution().analyzed().toJSON().count("expressions.RLike") < 5
    assert rows.first().e[0].code is None
