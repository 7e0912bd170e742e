"""Preparation, data-quality and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import prepare as P
from ..sources import testdata as td
from .registry import query
from .sqlparts import (ANSWERS, EVALUATIONS, PREDICTIONS, TRAINING, USERS, export_cte, level_name_sql,
                       policy_case, qid, sql_list, sql_str, values_items, with_)

_EXPORT = with_(ANSWERS, export_cte())
_RENAMED_SELECT = ", ".join(
    ["applicant", qid("Marca temporal"), qid("Consentimiento"), qid("EDAD"), qid("SITUACION LABORAL"),
     f"{qid('DISTRITO DE RESIDENCIA')} AS {qid('DISTRITO')}",
     f"{qid('NIVEL EDUCATIVO')} AS {qid('NIVEL_EDUCATIVO')}"]
    + [f"{qid(h)} AS {qid(q[0])}" for h, q in zip(P.QUESTION_HEADERS, fixed.ITEMS)]
    + [qid(fixed.PAYMENT_QUESTION)])


def _export(spark, sf_dir):
    return P.respondent_export(td.answers_long(spark, sf_dir))


def _aligned(spark, sf_dir):
    normalized = P.drop_by_rule(P.normalize_names(_export(spark, sf_dir)))
    return P.align(normalized, P.MODEL_FEATURES, keep=["applicant"])


@query("proj_drop", _EXPORT + 'SELECT * EXCLUDE ("EDAD", "SITUACION LABORAL") FROM export')
def proj_drop(spark, sf_dir):
    """Drop the fixed demographic columns."""
    return P.drop_columns(_export(spark, sf_dir), fixed.DROPPED_FEATURES)


@query("proj_drop_prefix", _EXPORT +
       'SELECT * EXCLUDE ("Marca temporal", "Consentimiento", "EDAD", "SITUACION LABORAL") FROM export')
def proj_drop_prefix(spark, sf_dir):
    """Drop by exact name or by prefix."""
    return P.drop_by_rule(_export(spark, sf_dir))


@query("proj_rename", _EXPORT + f"SELECT {_RENAMED_SELECT} FROM export")
def proj_rename(spark, sf_dir):
    """P4 + P5 on names: trim, strip the Likert prefix, fixed renames."""
    return P.normalize_names(_export(spark, sf_dir))


_ALIGN_COLS = ", ".join(["applicant"] + [qid(f) for f in P.MODEL_FEATURES])
_ALIGNED = _EXPORT.rstrip() + f", renamed AS (SELECT {_RENAMED_SELECT} FROM export)\n"


@query("proj_align", _ALIGNED + f"SELECT {_ALIGN_COLS} FROM renamed")
def proj_align(spark, sf_dir):
    """The model's features in model order."""
    return _aligned(spark, sf_dir)


@query("fill_cast", _ALIGNED + "SELECT applicant, " + ", ".join(
    f"COALESCE(CAST({qid(f)} AS VARCHAR), 'Desconocido') AS {qid(f)}" for f in P.MODEL_FEATURES)
    + " FROM renamed")
def fill_cast(spark, sf_dir):
    """Nulls to "Desconocido", everything to string, one projection."""
    return P.fill_cast(_aligned(spark, sf_dir), P.MODEL_FEATURES, keep=["applicant"])


@query("null_profile", _EXPORT + " UNION ALL ".join(
    f"SELECT {sql_str(c)} AS columna, COUNT(*) FILTER (WHERE {qid(c)} IS NULL) AS n_null FROM export"
    for c in P.EXPORT_COLUMNS[1:]))
def null_profile(spark, sf_dir):
    """Null count of every export column in one pass."""
    exp = _export(spark, sf_dir)
    return P.null_profile(exp, exp.columns[1:])


_PAT = fixed.LIKERT_PREFIX_PATTERN
_BR = fixed.BRACKET_PATTERN


def _strip_sql(s: str) -> str:
    t = f"trim({s})"
    return (f"CASE WHEN regexp_matches({t}, {sql_str(_PAT)}) "
            f"THEN trim(regexp_extract({t}, {sql_str(_PAT)}, 1)) ELSE {t} END")


@query("strip_prefix", with_(ANSWERS, values_items()) + f""", headers AS (
  SELECT a.item,
         {sql_str(fixed.LIKERT_PREFIX + ' [')} || i.question || ']' AS h1,
         {sql_str(fixed.LIKERT_PREFIX + ' [')} || i.question || '] [' || {level_name_sql('a.level')} || ']' AS h2
  FROM answers a JOIN items i ON a.item = i.item)
SELECT item, {_strip_sql('h1')} AS pregunta, {_strip_sql('h2')} AS codiciosa,
       CASE WHEN regexp_matches(h2, {sql_str(_BR)}) THEN regexp_extract(h2, {sql_str(_BR)}, 1) END AS primera,
       COUNT(*) AS n
FROM headers GROUP BY ALL""")
def strip_prefix(spark, sf_dir):
    """P5 on values: greedy anchored strip vs. non-greedy first bracket.

    Each answer carries its export header; a second header appends the
    answer in brackets (``prefix [q] [a]``), where greedy and non-greedy
    capture differ.
    """
    a = td.answers_long(spark, sf_dir)
    items = F.broadcast(td.items_df(spark).select("item", "question"))
    h = a.join(items, "item").select(
        "item",
        P.prefixed_header(F.col("question")).alias("h1"),
        F.concat(P.prefixed_header(F.col("question")), F.lit(" ["), C.level_name("level"), F.lit("]"))
        .alias("h2"),
    )
    return h.groupBy(
        "item",
        C.strip_likert_prefix("h1").alias("pregunta"),
        C.strip_likert_prefix("h2").alias("codiciosa"),
        C.first_bracket("h2").alias("primera"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("target_encode", with_(TRAINING) +
       "SELECT id, target, CASE WHEN target = 'Sí' THEN 1 ELSE 0 END AS label FROM training")
def target_encode(spark, sf_dir):
    """P6: "Sí" -> 1, else 0."""
    t = td.training(spark, sf_dir)
    return t.select("id", "target", C.target_code("target").alias("label"))


@query("pick_rows", with_(TRAINING) + "SELECT * FROM training ORDER BY id LIMIT 5")
def pick_rows(spark, sf_dir):
    """First n rows by key (TakeOrderedAndProject), never by position."""
    return td.training(spark, sf_dir).orderBy("id").limit(fixed.SMOKE_TEST_SAMPLES)


def _validation_sql() -> str:
    blank = lambda c: f"({c} IS NULL OR trim({c}) = '')"
    checks = [
        f"CASE WHEN {blank('nombre')} THEN 'nombre' END",
        f"CASE WHEN edad IS NULL OR edad < {fixed.AGE_MIN} OR edad > {fixed.AGE_MAX} THEN 'edad' END",
        f"CASE WHEN {blank('distrito')} THEN 'distrito' END",
        f"CASE WHEN {blank('nivel_educativo')} THEN 'nivel_educativo' END",
    ]
    lst = f"list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL)"
    return (with_(USERS) + f"SELECT usuario_id, nombre, edad, distrito, nivel_educativo, "
            f"array_to_string({lst}, ',') AS errores, len({lst}) = 0 AS valido FROM users")


@query("validate_rows", _validation_sql())
def validate_rows(spark, sf_dir):
    """One list of failed checks per row; valid rows have none."""
    return P.validate(td.users(spark, sf_dir))


_PILLAR_LIST = sql_list(fixed.PILLARS)


@query("completeness", with_(ANSWERS, values_items()) + f""", expected AS (
  SELECT pillar, COUNT(*) AS esperadas FROM items GROUP BY pillar),
answered AS (
  SELECT a.applicant, i.pillar, COUNT(DISTINCT a.item) AS respondidas
  FROM answers a JOIN items i ON a.item = i.item GROUP BY ALL),
grid AS (SELECT applicant, unnest({_PILLAR_LIST}) AS pillar FROM (SELECT DISTINCT applicant FROM answers))
SELECT g.applicant, g.pillar, COALESCE(r.respondidas, 0) AS respondidas, e.esperadas,
       e.esperadas - COALESCE(r.respondidas, 0) AS faltantes,
       round(COALESCE(r.respondidas, 0) * 100.0 / e.esperadas, 6) AS pct
FROM grid g LEFT JOIN answered r ON g.applicant = r.applicant AND g.pillar = r.pillar
JOIN expected e ON g.pillar = e.pillar""")
def completeness(spark, sf_dir):
    """Per applicant and pillar: answered, expected, missing, percent."""
    return P.completeness(td.answers_long(spark, sf_dir), td.items_df(spark))


@query("complete_applicants", with_(ANSWERS, values_items()) + f""", per_pillar AS (
  SELECT a.applicant, i.pillar, COUNT(DISTINCT a.item) AS n
  FROM answers a JOIN items i ON a.item = i.item GROUP BY ALL),
expected AS (SELECT pillar, COUNT(*) AS e FROM items GROUP BY pillar)
SELECT applicant, COUNT(*) FILTER (WHERE n = e) AS bloques, CAST(SUM(n) AS BIGINT) AS respondidas
FROM per_pillar p JOIN expected x ON p.pillar = x.pillar
GROUP BY applicant HAVING COUNT(*) FILTER (WHERE n = e) = {len(fixed.PILLARS)}""")
def complete_applicants(spark, sf_dir):
    """P20: applicants with every block complete (consent is constant here)."""
    return P.complete_applicants(td.answers_long(spark, sf_dir), td.items_df(spark))


_CONSENT = "applicant % 5 <> 0"  # stand-in: every fifth applicant did not agree


@query("complete_consented", with_(ANSWERS, values_items()) + f""", per_pillar AS (
  SELECT a.applicant, i.pillar, COUNT(DISTINCT a.item) AS n
  FROM answers a JOIN items i ON a.item = i.item WHERE {_CONSENT.replace('applicant', 'a.applicant')} GROUP BY ALL),
expected AS (SELECT pillar, COUNT(*) AS e FROM items GROUP BY pillar)
SELECT applicant, COUNT(*) FILTER (WHERE n = e) AS bloques, CAST(SUM(n) AS BIGINT) AS respondidas
FROM per_pillar p JOIN expected x ON p.pillar = x.pillar
GROUP BY applicant HAVING COUNT(*) FILTER (WHERE n = e) = {len(fixed.PILLARS)}""")
def complete_consented(spark, sf_dir):
    """P20: applicants with every block complete who gave their consent."""
    long = td.answers_long(spark, sf_dir)
    consent = long.select("applicant").distinct().withColumn("consentimiento", F.expr(_CONSENT))
    return P.complete_applicants(long, td.items_df(spark), consent)


@query("imputed_payment", _ALIGNED + f"""
SELECT {sql_str(fixed.PAYMENT_OPTIONS[1])} AS valor, count(*) AS n, count({qid(fixed.PAYMENT_QUESTION)}) AS antes FROM renamed""")
def imputed_payment(spark, sf_dir):
    """The payment column of all respondents set to one answer; how many
    had one before."""
    rows = _aligned(spark, sf_dir)
    before = P.qcol(P.column_about(rows, fixed.PAYMENT_FRAGMENT))
    kept = rows.withColumn("antes", before.isNotNull())
    done = P.impute(kept, P.column_about(rows, fixed.PAYMENT_FRAGMENT), fixed.PAYMENT_OPTIONS[1])
    return done.groupBy(P.qcol(fixed.PAYMENT_QUESTION).alias("valor")).agg(F.count(F.lit(1)).alias("n"), F.count_if("antes").alias("antes"))


@query("merge_blocks", with_(ANSWERS) + "SELECT applicant, " + ", ".join(
    f"max(CASE WHEN item = '{c}' THEN level END) AS {c}" for c in fixed.ITEM_CODES)
    + " FROM answers GROUP BY applicant")
def merge_blocks(spark, sf_dir):
    """Later submissions win per key, then one wide record per applicant."""
    events = td.answer_events(spark, sf_dir)
    latest = P.merge_latest(events, ["applicant", "item"], "level", "version")
    return P.pivot_items(latest)


@query("inject_demog", with_(USERS) + """
SELECT e.event_id AS id, COALESCE(u.distrito, '') AS "DISTRITO",
       COALESCE(u.nivel_educativo, '') AS "NIVEL_EDUCATIVO"
FROM events e LEFT JOIN users u ON e.user_id = u.usuario_id""")
def inject_demog(spark, sf_dir):
    """P10 + F9: user-record fields override survey keys, default ''."""
    s = td.submissions(spark, sf_dir)
    u = td.users(spark, sf_dir)
    j = s.join(u, "usuario_id", "left")
    return j.select("id", F.coalesce("distrito", F.lit("")).alias("DISTRITO"),
                    F.coalesce("nivel_educativo", F.lit("")).alias("NIVEL_EDUCATIVO"))


_DEMOG_HEADERS = P.EXPORT_DEMOGRAPHIC + [fixed.PAYMENT_QUESTION]


def _label_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, {sql_str(_BR)}) THEN regexp_extract({c}, {sql_str(_BR)}, 1) "
            f"WHEN contains({c}, {sql_str(fixed.PAYMENT_FRAGMENT)}) THEN {sql_str(fixed.LABEL_PAYMENT)} "
            f"WHEN contains({c}, 'DISTRITO') THEN {sql_str(fixed.LABEL_DISTRICT)} "
            f"WHEN contains({c}, 'NIVEL EDUCATIVO') THEN {sql_str(fixed.LABEL_EDUCATION)} ELSE {c} END")


@query("label_clean", with_(ANSWERS, values_items()) + f""", headers AS (
  SELECT {sql_str(fixed.LIKERT_PREFIX + ' [')} || i.question || ']' AS h
  FROM answers a JOIN items i ON a.item = i.item
  UNION ALL
  SELECT unnest({sql_list(_DEMOG_HEADERS)}) AS h FROM (SELECT DISTINCT applicant FROM answers))
SELECT {_label_sql('h')} AS etiqueta, COUNT(*) AS n FROM headers GROUP BY 1""")
def label_clean(spark, sf_dir):
    """friendly feature names for every header a respondent produced."""
    a = td.answers_long(spark, sf_dir)
    items = F.broadcast(td.items_df(spark).select("item", "question"))
    answer_headers = a.join(items, "item").select(P.prefixed_header(F.col("question")).alias("h"))
    other = a.select("applicant").distinct().select(
        F.explode(F.array(*[F.lit(x) for x in _DEMOG_HEADERS])).alias("h"))
    return (answer_headers.unionByName(other)
            .groupBy(C.label_clean("h").alias("etiqueta")).agg(F.count(F.lit(1)).alias("n")))


def _trunc_sql(c, limit, keep):
    return f"CASE WHEN length({c}) > {limit} THEN substr({c}, 1, {keep}) || '...' ELSE {c} END"


@query("truncate_label", with_(ANSWERS, values_items()) + f"""
SELECT a.item, {_trunc_sql('i.question', 68, 65)} AS t68, {_trunc_sql('i.question', 63, 60)} AS t63,
       {_trunc_sql(level_name_sql('a.level'), 12, 12)} AS t12, COUNT(*) AS n
FROM answers a JOIN items i ON a.item = i.item GROUP BY ALL""")
def truncate_label(spark, sf_dir):
    """68→65 (training log), 63→60 (explanation log), 12→12 (dashboard)."""
    a = td.answers_long(spark, sf_dir)
    items = F.broadcast(td.items_df(spark).select("item", "question"))
    j = a.join(items, "item")
    return j.groupBy(
        "item",
        C.truncate("question", 68, 65).alias("t68"),
        C.truncate("question", 63, 60).alias("t63"),
        C.truncate(C.level_name("level"), 12, 12).alias("t12"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("first_word", with_(USERS) +
       "SELECT usuario_id, string_split(nombre, ' ')[1] AS primer_nombre FROM users")
def first_word(spark, sf_dir):
    """greeting name = first word."""
    return td.users(spark, sf_dir).select("usuario_id", C.first_word("nombre").alias("primer_nombre"))


@query("fmt_pct", with_(PREDICTIONS) + """
SELECT evaluacion_id, printf('%.1f', round(p_default * 100.0, 1)) || '%' AS pct_texto,
       printf('%+.4f', round(p_default - 0.3, 4)) AS delta_texto
FROM predictions""")
def fmt_pct(spark, sf_dir):
    """percent with one decimal and a signed 4-decimal delta."""
    p = td.predictions(spark, sf_dir)
    return p.select("evaluacion_id", C.fmt_percent("p_default", 1).alias("pct_texto"),
                    C.fmt_signed(F.col("p_default") - F.lit(0.3), 4).alias("delta_texto"))


@query("to_level", f"""
SELECT event_id, CAST(round_even(least(greatest(value / 100.0, 1.0), 5.0), 0) AS INTEGER) AS nivel,
       {sql_list(fixed.LIKERT_LEVELS)}[CAST(round_even(least(greatest(value / 100.0, 1.0), 5.0), 0) AS INTEGER)]
         AS respuesta
FROM events""")
def to_level(spark, sf_dir):
    """clip to 1..5, round half-even, level name by index."""
    e = td.table(spark, sf_dir, "events")
    idx = C.to_level_index(F.col("value") / F.lit(100.0))
    return e.select("event_id", idx.alias("nivel"), C.level_name(idx).alias("respuesta"))


@query("fmt_ts", with_(EVALUATIONS) + """
SELECT evaluacion_id, strftime(fecha, '%Y-%m-%dT%H:%M:%S') AS iso,
       strftime(fecha, '%Y/%m/%d %H:%M:%S') AS reloj, strftime(fecha, '%d/%m/%Y, %H:%M') AS local
FROM evaluations""")
def fmt_ts(spark, sf_dir):
    """ISO, client clock and dashboard formats (session zone UTC)."""
    e = td.evaluations(spark, sf_dir)
    return e.select("evaluacion_id", C.fmt_iso("fecha").alias("iso"), C.fmt_clock("fecha").alias("reloj"),
                    C.fmt_local("fecha").alias("local"))


@query("json_decode", """
SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
       COALESCE(value, 0.0) AS valor
FROM events""")
def json_decode(spark, sf_dir):
    """F7 + G2 fix-ups: decode payload (malformed → null), null amount → 0."""
    e = td.table(spark, sf_dir, "events")
    return e.select("event_id", C.json_or_null("props", "k INT").getField("k").alias("k"),
                    F.coalesce("value", F.lit(0.0)).alias("valor"))


@query("fmt_money", with_(USERS, EVALUATIONS, PREDICTIONS) + f"""
SELECT e.evaluacion_id,
       CASE WHEN m > 0 THEN 'S/ ' || format('{{:,.2f}}', m) ELSE '—' END AS monto_texto
FROM (SELECT evaluacion_id, {policy_case('p_default', 'monto')} AS m FROM predictions) e
JOIN evaluations v ON e.evaluacion_id = v.evaluacion_id
JOIN users u ON v.usuario_id = u.usuario_id""")
def fmt_money(spark, sf_dir):
    """money text with thousands mark and 2 decimals; dash when 0."""
    rows = C.with_policy(td.predictions(spark, sf_dir), "p_default")
    j = rows.join(td.evaluations(spark, sf_dir), "evaluacion_id").join(td.users(spark, sf_dir), "usuario_id")
    return j.select("evaluacion_id", C.fmt_money("monto").alias("monto_texto"))
