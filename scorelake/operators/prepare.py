"""Preparation and data quality.

Column-name work (drop, rename, prefix strip, align) is schema metadata: it
is computed on the driver from ``df.columns`` and applied as one ``select``,
so it adds no job.  Value work is Column expressions and hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed


def qcol(name: str) -> Column:
    """Column by exact name (question texts contain dots and brackets)."""
    return F.col("`" + name.replace("`", "``") + "`")


def prefixed_header(question) -> Column:
    return F.concat(F.lit(fixed.LIKERT_PREFIX + " ["), question, F.lit("]"))


def header_text(question: str) -> str:
    return f"{fixed.LIKERT_PREFIX} [{question}]"


QUESTION_HEADERS = [header_text(q[0]) for q in fixed.ITEMS]
EXPORT_DEMOGRAPHIC = ["Marca temporal", "Consentimiento", "EDAD", "SITUACION LABORAL",
                      "DISTRITO DE RESIDENCIA", "NIVEL EDUCATIVO"]
EXPORT_COLUMNS = ["applicant", *EXPORT_DEMOGRAPHIC, *QUESTION_HEADERS, fixed.PAYMENT_QUESTION]
# model features after name normalisation, in model order
MODEL_FEATURES = ["DISTRITO", "NIVEL_EDUCATIVO", *[q[0] for q in fixed.ITEMS], fixed.PAYMENT_QUESTION]


def _pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), key)


def respondent_export(answers: DataFrame) -> DataFrame:
    """Raw questionnaire export: one row per applicant, long headers.

    ``answers`` is the long table (applicant, item, level, answered_at).  The
    pivot is a conditional aggregate over an explicit item list: one hash
    aggregate, partial per task, no value-discovery job.  Demographics are
    drawn from the fixed vocabularies by applicant id.
    """
    a = F.col("applicant")
    aggs = [F.max("answered_at").alias("_ts")]
    for i, code in enumerate(fixed.ITEM_CODES):
        aggs.append(F.max(F.when(F.col("item") == code, C.level_name("level")))
                    .alias(QUESTION_HEADERS[i]))
    wide = answers.groupBy("applicant").agg(*aggs)
    return wide.select(
        a,
        C.fmt_clock("_ts").alias("Marca temporal"),
        F.lit("Acepto").alias("Consentimiento"),
        (F.lit(10) + a % 80).alias("EDAD"),
        _pick(fixed.TRAIN_JOBS, a % len(fixed.TRAIN_JOBS)).alias("SITUACION LABORAL"),
        _pick(fixed.TRAIN_DISTRICTS, a % len(fixed.TRAIN_DISTRICTS)).alias("DISTRITO DE RESIDENCIA"),
        _pick(fixed.TRAIN_EDUCATION, a % len(fixed.TRAIN_EDUCATION)).alias("NIVEL EDUCATIVO"),
        *[qcol(h) for h in QUESTION_HEADERS],
        F.lit(None).cast("string").alias(fixed.PAYMENT_QUESTION),
    )


# ---------------------------------------------------------------- P1, P2
def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop fixed columns (absent names are ignored, as ``drop`` does)."""
    return df.drop(*names)


def drop_by_rule(df: DataFrame, exact=None, prefixes=None) -> DataFrame:
    """Drop by exact (trimmed) name or by prefix."""
    exact = exact if exact is not None else fixed.EXCLUDED_EXACT
    prefixes = prefixes if prefixes is not None else fixed.EXCLUDED_PREFIXES
    keep = [c for c in df.columns
            if c.strip() not in exact and not any(c.strip().startswith(p) for p in prefixes)]
    return df.select(*[qcol(c) for c in keep])


# ---------------------------------------------------------------- P4, P5
def normalize_names(df: DataFrame) -> DataFrame:
    """P4 + P5: trim names, strip the Likert prefix, apply fixed renames.

    Names pass through the same Column rule as values do, as a table of one
    row per column.
    """
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "at int, name string")
    ruled = names.select("at", C.strip_likert_prefix("name").alias("name")).replace(fixed.COLUMN_RENAMES, subset=["name"])
    new = {r["at"]: r["name"] for r in ruled.collect()}
    return df.toDF(*[new[i] for i in range(len(df.columns))])


# ---------------------------------------------------------------- P3, P7
def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    have = set(df.columns)
    return [f for f in features if f not in have]


def align(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """P3 + P7: fail listing missing features, else select in model order."""
    missing = missing_features(df, features)
    if missing:
        raise ValueError(f"missing model features: {missing}")
    return df.select(*[qcol(c) for c in (keep or [])], *[qcol(f) for f in features])


# ---------------------------------------------------------------- P8, P15
def column_about(df: DataFrame, fragment: str) -> str:
    """The one column whose name has ``fragment``; none or several raise,
    naming them."""
    hits = sorted(filter(lambda name: fragment in name, df.schema.names))
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} columns contain {fragment!r}: {hits}")
    return hits[0]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# ---------------------------------------------------------------- P11, P12
def fill_cast(df: DataFrame, features: list[str], fill: str = "Desconocido",
              keep: list[str] | None = None) -> DataFrame:
    """Every feature to string, nulls to ``fill`` — one projection."""
    return df.select(*[qcol(c) for c in (keep or [])],
                     *[F.coalesce(qcol(f).cast("string"), F.lit(fill)).alias(f) for f in features])


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count of every column in one aggregate pass, long output."""
    columns = columns or df.columns
    wide = df.agg(*[F.count_if(qcol(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"_n{i}").alias("n_null"))
                      for i, c in enumerate(columns)])
    return wide.select(F.inline(pairs))


# ---------------------------------------------------------------- P13
def impute(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.lit(value))


# ---------------------------------------------------------------- P9
def first_value(values: Column) -> Column:
    """Element 0 of a list-valued answer (null for an empty list)."""
    return F.get(values, 0)


# ---------------------------------------------------------------- P18
def validation_codes(nombre="nombre", edad="edad", distrito="distrito",
                     nivel="nivel_educativo", situacion=None) -> Column:
    """List of failed checks; empty list = valid row."""
    def blank(c):
        return F.col(c).isNull() | (F.trim(F.col(c)) == "")
    age = F.col(edad)
    checks = [
        F.when(blank(nombre), F.lit("nombre")),
        F.when(age.isNull() | (age < fixed.AGE_MIN) | (age > fixed.AGE_MAX), F.lit("edad")),
        F.when(blank(distrito), F.lit("distrito")),
        F.when(blank(nivel), F.lit("nivel_educativo")),
    ]
    if situacion:
        checks.append(F.when(blank(situacion), F.lit("situacion_laboral")))
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, **names) -> DataFrame:
    codes = validation_codes(**names)
    return df.withColumn("errores", F.array_join(codes, ",")).withColumn(
        "valido", F.size(codes) == 0)


# ---------------------------------------------------------------- P19, P20
def completeness(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Answered / expected / missing / percent per (applicant, pillar).

    ``answers`` holds one row per (applicant, item), so per-pillar counts are
    ``count_if`` columns of a single aggregate over answers ⋈ the 30-row item
    dictionary (broadcast); ``stack`` then yields every pillar of every
    applicant (zeros included) — one pass over the answers, no grid join.
    """
    expected = {r["pillar"]: r["n"] for r in
                items.groupBy("pillar").agg(F.count(F.lit(1)).alias("n")).collect()}
    j = answers.join(F.broadcast(items.select("item", "pillar")), "item")
    wide = j.groupBy("applicant").agg(
        *[F.count_if(F.col("pillar") == p).alias(f"_n{i}") for i, p in enumerate(fixed.PILLARS)])
    args = ", ".join(f"'{p}', _n{i}, {expected.get(p, 0)}L" for i, p in enumerate(fixed.PILLARS))
    long = wide.selectExpr("applicant", f"stack({len(fixed.PILLARS)}, {args}) AS (pillar, respondidas, esperadas)")
    return long.select(
        "applicant", "pillar", "respondidas", "esperadas",
        (F.col("esperadas") - F.col("respondidas")).alias("faltantes"),
        C.r6(F.col("respondidas") * F.lit(100.0) / F.col("esperadas")).alias("pct"))


def complete_applicants(answers: DataFrame, items: DataFrame, consent: DataFrame | None = None) -> DataFrame:
    """P20: all four pillars fully answered (and consent, when given)."""
    per_pillar = (
        answers.join(F.broadcast(items.select("item", "pillar")), "item")
        .groupBy("applicant", "pillar").agg(F.count_distinct("item").alias("n"))
        .join(F.broadcast(items.groupBy("pillar").agg(F.count(F.lit(1)).alias("e"))), "pillar")
    )
    out = (per_pillar.groupBy("applicant")
           .agg(F.count_if(F.col("n") == F.col("e")).alias("bloques"), F.sum("n").alias("respondidas"))
           .filter(F.col("bloques") == len(fixed.PILLARS)))
    if consent is not None:
        out = out.join(consent.filter(F.col("consentimiento")).select("applicant"), "applicant", "left_semi")
    return out


# ---------------------------------------------------------------- P21
def merge_latest(events: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Later blocks win — ``max_by(value, order)`` per key (partial agg)."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def pivot_items(long_df: DataFrame, value: str = "level") -> DataFrame:
    """Long → wide with the explicit item list (conditional aggregation)."""
    return long_df.groupBy("applicant").agg(
        *[F.max(F.when(F.col("item") == c, F.col(value))).alias(c) for c in fixed.ITEM_CODES])
