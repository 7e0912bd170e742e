"""Structured Streaming queries (T1, T2, P18, J2, W1): request documents are
written as JSON files, drained once with ``availableNow`` through the stored
survey scorecard, and read back from the committed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import prepare as P
from ..operators import reconcile as R
from ..operators import scorecard
from ..session import cut_lineage, shared_path
from ..sources import files
from ..sources import testdata as td
from ..streaming import submissions as SS
from .registry import query
from .sqlparts import level_name_sql, policy_case, r6, sql_list, sql_str
from .survey import FEATURES, MODEL_SQL, model

VERSION = "survey-1"
#: Files of request documents a micro-batch takes.
FILES_A_BATCH = 4

_ITEMS = ", ".join(f"('{code}', {sql_str(q)})" for code, (q, *_) in zip(fixed.ITEM_CODES, fixed.ITEMS))
_VERSION_ORDER = "l_shipdate {0}, l_linenumber {0}, l_quantity {0}, l_partkey {0}, l_orderkey {0}"
_INPUT_SQL = f"""items_q AS (SELECT * FROM (VALUES {_ITEMS}) AS t(item, question)),
sent AS (
  SELECT applicant, item, CAST(substr(item, 2, 2) AS INTEGER) AS no, max(level) FILTER (newest = 1) AS level, max(level) FILTER (oldest = 1) AS first, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY applicant, item ORDER BY {_VERSION_ORDER.format('DESC')}) AS newest,
               row_number() OVER (PARTITION BY applicant, item ORDER BY {_VERSION_ORDER.format('ASC')}) AS oldest FROM answer_events) GROUP BY applicant, item),
inputs AS (
  SELECT applicant, 2 * no AS ord, question AS name, {level_name_sql('level')} AS v, CASE WHEN (applicant + no) % 97 = 0 THEN 2 ELSE 1 END AS n_values
  FROM sent JOIN items_q USING (item)
  UNION ALL
  SELECT applicant, 2 * no + CASE WHEN (applicant + no) % 2 = 0 THEN 1 ELSE -1 END, question || 'x', {level_name_sql('first')}, 1
  FROM sent JOIN items_q USING (item) WHERE n > 1
  UNION ALL
  SELECT DISTINCT applicant, 999, 'Comentario libre', 'ninguno', 1 FROM sent WHERE applicant % 17 = 0),
near AS (
  SELECT name, item AS code, question FROM (SELECT DISTINCT name FROM inputs), items_q
  WHERE 1.0 - levenshtein(name, question) / greatest(strlen(name), strlen(question)) >= {fixed.FUZZY_CUTOFF}
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, question) / greatest(strlen(name), strlen(question)), question) = 1),
named AS MATERIALIZED (SELECT i.*, n.code, n.question FROM inputs i LEFT JOIN near n USING (name))"""

_SCORED_SQL = MODEL_SQL + ", " + _INPUT_SQL + f""",
given AS MATERIALIZED (SELECT applicant, code, arg_max(v, ord) AS v FROM named WHERE code IS NOT NULL GROUP BY ALL),
who AS (
  SELECT applicant AS id, CASE WHEN applicant % 11 = 0 THEN ' ' ELSE 'Postulante ' || CAST(applicant AS VARCHAR) END AS nombre, 10 + applicant % 80 AS edad,
         {sql_list(fixed.TRAIN_DISTRICTS)}[applicant % {len(fixed.TRAIN_DISTRICTS)} + 1] AS distrito,
         {sql_list(fixed.TRAIN_EDUCATION)}[applicant % {len(fixed.TRAIN_EDUCATION)} + 1] AS nivel,
         CASE WHEN applicant % 13 <> 0 THEN {sql_list(fixed.TRAIN_JOBS)}[applicant % {len(fixed.TRAIN_JOBS)} + 1] END AS puesto,
         bool_or(code IS NULL) AS otra, bool_or(code IS NOT NULL AND n_values > 1) AS lista, count(DISTINCT code) AS n
  FROM named GROUP BY applicant),
checked AS MATERIALIZED (
  SELECT *, list_filter([CASE WHEN trim(nombre) = '' THEN 'nombre' END, CASE WHEN edad < {fixed.AGE_MIN} OR edad > {fixed.AGE_MAX} THEN 'edad' END,
                         CASE WHEN puesto IS NULL THEN 'situacion_laboral' END, CASE WHEN otra THEN 'desconocida' END,
                         CASE WHEN lista THEN 'lista' END, CASE WHEN n < {len(fixed.ITEM_CODES)} THEN 'falta' END], lambda x: x IS NOT NULL) AS codes FROM who),
wide AS (
  SELECT id, f.feature, f.level FROM (
    SELECT applicant AS id, code AS feature, v AS level FROM given UNION ALL SELECT id, 'distrito', distrito FROM who UNION ALL SELECT id, 'nivel', nivel FROM who) f
  JOIN checked USING (id) WHERE len(codes) = 0),
consts AS (SELECT feature, min(unseen) AS unseen, min(mean_w) AS mean_w, min(intercept) AS intercept FROM card GROUP BY feature),
terms AS MATERIALIZED (
  SELECT w.id, w.feature, w.level, coalesce(c.weight, k.unseen) AS weight, coalesce(c.weight, k.unseen) - k.mean_w AS phi, k.intercept
  FROM wide w JOIN consts k USING (feature) LEFT JOIN card c ON c.feature = w.feature AND c.level = w.level),
result AS MATERIALIZED (SELECT id, 1.0 / (1.0 + exp(-(min(intercept) + sum(weight)))) AS p FROM terms GROUP BY id)
"""


def stored_model(spark, sf_dir, base: str) -> scorecard.Loaded:
    """The survey scorecard, trained, stored, and loaded from where it is stored."""
    m = model(spark, sf_dir)
    path = files.save_table_model(m.card, f"{base}/model/{VERSION}")
    m.release()
    return scorecard.load(files.load_table_model(spark, path), VERSION, FEATURES)


def _requests(spark, sf_dir):
    return td.request_stream(spark, sf_dir, P.prefixed_header)


def _run(spark, sf_dir):
    base = shared_path(spark, "stream")
    loaded = stored_model(spark, sf_dir, base)
    docs = files.write_json(_requests(spark, sf_dir), f"{base}/requests")
    SS.run_stream(spark, docs, loaded, base, FILES_A_BATCH)
    return base, loaded


@query("stream_score", _SCORED_SQL + f"""
SELECT id, len(codes) = 0 AS valido, array_to_string(codes, ',') AS errores, round(p, 6) AS p_default,
       {', '.join(f"CASE WHEN p IS NOT NULL THEN {policy_case('p', c)} END AS {c}" for c in ('estado', 'tramo', 'monto'))},
       CASE WHEN p IS NOT NULL THEN '{VERSION}' END AS model_version
FROM checked LEFT JOIN result USING (id)""")
def stream_score(spark, sf_dir):
    """Every request document reconciled, checked and, if nothing failed,
    scored and tiered by the stored survey scorecard; the rest is in quarantine."""
    base, _ = _run(spark, sf_dir)
    decided = ["p_default", "estado", "tramo", "monto", "model_version"]
    ok = SS.read_table(spark, base, "predictions").select("id", F.lit(True).alias("valido"), F.lit("").alias("errores"), C.r6("p_default").alias("p_default"), *decided[1:])
    bad = SS.read_table(spark, base, "quarantine").select("id", F.lit(False).alias("valido"), "errores", *[F.lit(None).cast(ok.schema[c].dataType).alias(c) for c in decided])
    return ok.unionByName(bad)


@query("stream_quarantine", _SCORED_SQL + """
SELECT codigo, count(*) AS n, (SELECT count(*) FROM checked WHERE len(codes) > 0) AS en_cuarentena, (SELECT count(*) FROM checked) AS recibidas
FROM (SELECT unnest(codes) AS codigo FROM checked) GROUP BY codigo""")
def stream_quarantine(spark, sf_dir):
    """How often each check sent a document to quarantine, and that valid
    and quarantined documents are all that came in."""
    base, _ = _run(spark, sf_dir)
    bad = cut_lineage(SS.read_table(spark, base, "quarantine").select(F.explode(F.split("errores", ",")).alias("codigo"), "id"))
    held = SS.read_table(spark, base, "quarantine").count()
    received = held + SS.read_table(spark, base, "predictions").count()
    return bad.groupBy("codigo").agg(F.count(F.lit(1)).alias("n")).select("codigo", "n", F.lit(held).cast("long").alias("en_cuarentena"), F.lit(received).cast("long").alias("recibidas"))


@query("stream_explained", _SCORED_SQL + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(phi), 9) DESC, feature) AS r FROM terms)
SELECT r.id, c.nombre, c.puesto AS situacion_laboral, {policy_case('p', 'estado')} AS estado, {policy_case('p', 'monto')} AS monto,
       {r6('(SELECT min(intercept) + sum(mean_w) FROM consts)')} AS base_value,
       '{{"features":["' || string_agg(r.feature, '","' ORDER BY r) FILTER (r <= {fixed.TOP_FEATURES}) || '"]}}' AS documento, string_agg(feature, ',' ORDER BY r) FILTER (r <= {fixed.TOP_FEATURES}) AS features,
       string_agg(level, '|' ORDER BY r) FILTER (r <= {fixed.TOP_FEATURES}) AS inputs, {r6(f'sum(phi) FILTER (r <= {fixed.TOP_FEATURES})')} AS suma
FROM ranked r JOIN checked c ON c.id = r.id JOIN result ON result.id = r.id GROUP BY ALL""")
def stream_explained(spark, sf_dir):
    """W1 + G2: the stored users, evaluations and predictions joined, each with
    job, decision and the one explanation document that its prediction holds,
    which becomes JSON only here."""
    base, _ = _run(spark, sf_dir)
    top = F.col("explicacion.top_features")
    joined = (SS.read_table(spark, base, "evaluations").select("id")
              .join(SS.read_table(spark, base, "predictions"), "id").join(SS.read_table(spark, base, "users").select("id", "nombre", "situacion_laboral"), "id"))
    return joined.select(
        "id", "nombre", "situacion_laboral", "estado", "monto", C.r6("explicacion.base_value").alias("base_value"),
        F.to_json(F.struct(F.transform(top, lambda x: x["feature"]).alias("features"))).alias("documento"), F.array_join(F.transform(top, lambda x: x["feature"]), ",").alias("features"),
        F.array_join(F.transform(top, lambda x: x["input_value"]), "|").alias("inputs"),
        C.r6(F.aggregate(top, F.lit(0.0), lambda s, x: s + x["shap_value"])).alias("suma"))


@query("persist_three", _SCORED_SQL + f"""
SELECT id, nombre, CAST(edad AS BIGINT) AS edad, distrito, round(p, 6) AS p_default, {policy_case('p', 'monto')} AS monto
FROM checked JOIN result USING (id)""")
def persist_three(spark, sf_dir):
    """Three tables per micro-batch under one commit; batch 0 is then sent
    once more, which changes nothing, and once as a batch that was lost before
    its commit, which stores no submission twice."""
    base, loaded = _run(spark, sf_dir)
    again = cut_lineage(SS.score_requests(spark.read.schema(SS.STREAM_SCHEMA).json(f"{base}/requests"), loaded))
    SS.write_batch(again, 0, base)
    SS.write_batch(again, 1_000_000, base)
    u = SS.read_table(spark, base, "users").select("id", "nombre", "edad", "distrito")
    e = SS.read_table(spark, base, "evaluations").select("id")
    p = SS.read_table(spark, base, "predictions").select("id", C.r6("p_default").alias("p_default"), "monto")
    return e.join(p, "id").join(u, "id").select("id", "nombre", "edad", "distrito", "p_default", "monto")


@query("fuzzy_last_wins", MODEL_SQL + ", " + _INPUT_SQL + """
SELECT applicant AS id, coalesce(question, name) AS feature, arg_max(v, ord) AS respuesta, count(*) AS entradas
FROM named GROUP BY applicant, coalesce(question, name)""")
def fuzzy_last_wins(spark, sf_dir):
    """Inputs reconciled by name on a table of documents; of several inputs
    on one feature the last wins."""
    docs = _requests(spark, sf_dir).select("id", F.posexplode(F.map_entries("data")).alias("at", "e"))
    inputs = cut_lineage(docs.select("id", "at", C.strip_likert_prefix("e.key").alias("input"), P.first_value(F.col("e.value")).alias("respuesta"))
                         .where(F.col("input") != fixed.PAYMENT_QUESTION))
    canonical = td.items_df(spark).select(F.col("question").alias("canonical"))
    return R.last_wins(inputs, "id", "at", R.fuzzy_map(inputs.select("input"), canonical), "respuesta").select("id", "feature", "respuesta", "entradas")
