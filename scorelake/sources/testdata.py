"""Survey tables built from the driver's parquet tables (FIXTURES §2).

Each adapter is a lazy projection/aggregation over ``spark.read.parquet``;
Catalyst prunes the scan to the columns used and pushes filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed
from ..functions.columns import level_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- users
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation: one user per customer (nation is 25 rows)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return (
        c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .select(
            F.col("c_custkey").alias("usuario_id"),
            F.col("c_name").alias("nombre"),
            (F.lit(10) + F.col("c_custkey") % 80).alias("edad"),
            F.col("n_name").alias("distrito"),
            F.col("c_mktsegment").alias("nivel_educativo"),
        )
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("evaluacion_id"),
        F.col("o_custkey").alias("usuario_id"),
        F.col("o_orderdate").alias("fecha"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(default) per evaluation from integer sums (exact thresholds)."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(F.col("l_orderkey").alias("evaluacion_id"))
        .agg(
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("_s"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select("evaluacion_id",
                (F.col("_s").cast("double") / (F.lit(10.0) * F.col("_n"))).alias("p_default"))
    )


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("evaluacion_id"),
        F.col("l_linenumber").alias("linea"),
        (F.round(F.col("l_discount") * 100).cast("long").cast("double") / F.lit(10.0)).alias("p"),
    )


# ---------------------------------------------------------------- answers
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem is one submitted answer (several per applicant/item)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") * 6 + F.col("l_orderkey") % 6).alias("applicant"),
        F.format_string("q%02d", (F.col("l_partkey") % 30 + 1).cast("int")).alias("item"),
        (F.col("l_quantity") % 5 + 1).cast("int").alias("level"),
        F.struct(
            F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_quantity"),
            F.col("l_partkey"), F.col("l_orderkey"),
        ).alias("version"),
    )


def answers_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest answer per (applicant, item): ``max_by`` over a version struct.

    A hash aggregate with map-side partial aggregation: each task keeps one
    candidate per key before the shuffle, so a hot applicant costs one row
    per item per task, not its whole history.
    """
    return (
        answer_events(spark, sf_dir)
        .groupBy("applicant", "item")
        .agg(F.max_by("level", "version").alias("level"),
             F.max("version").getField("l_shipdate").alias("answered_at"))
    )


# ---------------------------------------------------------------- survey training
SURVEY_FEATURES = ["distrito", "nivel", *fixed.ITEM_CODES]
#: Positive: mean of round(100 * discount) over an applicant's lines of SURVEY_CUT / 10 or more.
SURVEY_CUT = 52


def survey_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per applicant: district, education, 30 answers as texts
    (unanswered: "Desconocido") and a target from the applicant's own lines."""
    level = lambda code: F.max(F.when(F.col("item") == code, F.col("level")))
    wide = answers_long(spark, sf_dir).groupBy("applicant").agg(*[level(c).alias(c) for c in fixed.ITEM_CODES])
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") * 6 + F.col("l_orderkey") % 6).alias("applicant"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    total = lines.groupBy("applicant").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("applicant") % len(values)).cast("int"))
    return wide.join(total, "applicant").select(
        F.col("applicant").alias("id"), pick(fixed.TRAIN_DISTRICTS).alias("distrito"), pick(fixed.TRAIN_EDUCATION).alias("nivel"),
        *[F.coalesce(C.level_name(c), F.lit("Desconocido")).alias(c) for c in fixed.ITEM_CODES],
        F.when(F.col("s") * 10 >= F.col("n") * SURVEY_CUT, F.lit(fixed.TARGET_POSITIVE)).otherwise(F.lit("No")).alias("target"))


DEMOGRAPHIC = ["situacion", "edad"]


def survey_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``survey_training`` with the two demographic columns that the last two
    training iterations leave out: job type (text) and age (number)."""
    a = F.col("id")
    job = F.get(F.array(*map(F.lit, fixed.TRAIN_JOBS)), (a % len(fixed.TRAIN_JOBS)).cast("int"))
    return survey_training(spark, sf_dir).withColumn("situacion", job).withColumn("edad", (F.lit(10) + a % 80).cast("long"))


# ---------------------------------------------------------------- training
def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (
        d.join(lab, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("distrito"),
            F.col("lang").alias("nivel"),
            F.length(F.bin("n_chars")).cast("long").alias("tamano"),
            F.when(F.col("quality") == 0, F.lit(fixed.TARGET_POSITIVE)).otherwise(F.lit("No"))
            .alias("target"),
        )
    )


FEATURES = ["distrito", "nivel", "tamano"]


# ---------------------------------------------------------------- stream input
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("time"),
        F.col("user_id").alias("usuario_id"),
        F.col("event_type").alias("kind"),
        F.col("value"),
        F.col("props").alias("payload"),
    )


SUBMISSION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("usuario_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("payload", T.StringType()),
])


def request_stream(spark: SparkSession, sf_dir: str, question_key) -> DataFrame:
    """Request documents (id, time, data, user_info) as a form sends them: for
    every question the latest answer under its header, and where an applicant
    answered it more than once an earlier answer under a header with a typing
    error, after or before the other; some lists of two, some unknown keys,
    blank names and missing jobs. ``question_key`` turns a question into a header."""
    a, item_no = F.col("applicant"), F.substring("item", 2, 2).cast("int")
    latest = answer_events(spark, sf_dir).groupBy("applicant", "item").agg(
        F.max_by("level", "version").alias("level"), F.min_by("level", "version").alias("first"), F.count(F.lit(1)).alias("n"),
        F.max("version").getField("l_shipdate").alias("at"))
    j = latest.join(F.broadcast(items_df(spark).select("item", "question")), "item")
    value = F.when((a + item_no) % 97 == 0, F.array(C.level_name("level"), C.level_name("first"))).otherwise(F.array(C.level_name("level")))
    main = F.struct((2 * item_no).alias("at"), question_key(F.col("question")).alias("key"), value.alias("value"))
    typo = F.struct((2 * item_no + F.when((a + item_no) % 2 == 0, 1).otherwise(-1)).alias("at"),
                    question_key(F.concat("question", F.lit("x"))).alias("key"), F.array(C.level_name("first")).alias("value"))
    sent = j.select("applicant", "at", F.when(F.col("n") > 1, F.array(main, typo)).otherwise(F.array(main)).alias("e"))
    docs = sent.groupBy("applicant").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"), F.max("at").alias("time"))
    none = F.array().cast("array<string>")
    extra = F.when(a % 17 == 0, F.array(F.struct(F.lit(999).alias("at"), F.lit("Comentario libre").alias("key"), F.array(F.lit("ninguno")).alias("value"))))
    paid = F.array(F.struct(F.lit(1000).alias("at"), F.lit(fixed.PAYMENT_QUESTION).alias("key"), none.alias("value")))
    entries = F.concat("e", F.coalesce(extra, F.slice(paid, 1, 0)), paid)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (a % len(values)).cast("int"))
    return docs.select(a.alias("id"), F.col("time").cast("timestamp").alias("time"),
                       F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"]))).alias("data"),
                       F.struct(F.when(a % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Postulante "), a.cast("string"))).alias("nombre"),
                                (F.lit(10) + a % 80).cast("long").alias("edad"), pick(fixed.TRAIN_DISTRICTS).alias("distrito"),
                                pick(fixed.TRAIN_EDUCATION).alias("nivel_educativo"),
                                F.when(a % 13 != 0, pick(fixed.TRAIN_JOBS)).alias("situacion_laboral")).alias("user_info"))


# ---------------------------------------------------------------- keys
def keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(inputs, canonical): distinct part names and the same names + 'x'."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    canonical = p.select(F.col("p_name").alias("canonical"))
    inputs = p.select(F.concat(F.col("p_name"), F.lit("x")).alias("input"))
    return inputs, canonical


# ---------------------------------------------------------------- literals
def items_df(spark: SparkSession) -> DataFrame:
    rows = [
        (fixed.item_code(i + 1), q, pillar, subdim, rev, intensity)
        for i, (q, pillar, subdim, rev, intensity) in enumerate(fixed.ITEMS)
    ]
    return spark.createDataFrame(
        rows, "item string, question string, pillar string, subdim string, "
              "reverse boolean, intensity string")


# Counterfactual scenarios override the ``nivel`` feature (FIXTURES §2).
SCENARIOS = [("imputed", "en"), ("sin_obligaciones", "es"), ("moroso_declarado", "de")]
