"""Submission stream: reconcile → check → score → explain → tables.

T1 is a pure ``DataFrame → DataFrame`` function of request documents, shared
by batch and stream: question names are reconciled with the model's items
(exactly, else by the closest name), of several inputs on one feature the last
wins, features are aligned, every check leaves a code, and rows without a code
are scored with a stored scorecard, whose version each row records, and
explained. All of it stays in the row: no join, no shuffle, no state.

T2 is the ``foreachBatch`` sink. A micro-batch goes to three tables and, where a
check failed, to quarantine; all four are written to the batch's own folders,
and a marker in the commit log, written last, makes them visible together:
readers take committed batches only. A crash between the writes leaves the
batch out of all tables until its replay, which overwrites what there is. A
replay of a committed batch changes nothing, so its rows keep the version of
the model that scored them; an uncommitted one is scored by the version of the
run that commits it. A submission that another committed batch stored is not
stored again; one in quarantine may be sent again. Checkpoints and tables live
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed
from ..operators import prepare as P
from ..operators import reconcile as R
from ..operators import scorecard as S
from ..sources import files

#: Names that a document may hold: the questions, and the payment question,
#: which is no feature of the scorecard.
PAYMENT = "pago"
NAMES = {question: code for code, (question, *_) in zip(fixed.ITEM_CODES, fixed.ITEMS)} | {fixed.PAYMENT_QUESTION: PAYMENT}

STREAM_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("time", T.TimestampType()), *files.REQUEST_SCHEMA.fields[1:]])

TABLES = {
    "users": ["id", "usuario_id", "nombre", "edad", "distrito", "nivel_educativo", "situacion_laboral"],
    "evaluations": ["id", "usuario_id", "time", "datos", "respuestas"],
    "predictions": ["id", "p_default", "estado", "tramo", "monto", "model_version", "explicacion"],
    "quarantine": ["id", "time", "datos", "nombre", "edad", "distrito", "nivel_educativo", "situacion_laboral", "errores"],
}


# ---------------------------------------------------------------- T1
def aligned(docs: DataFrame) -> DataFrame:
    """The model's row of every request document (id, time, data, user_info):
    user fields, one column per item (the last input's first value), ``datos``
    (the raw document) and ``codes``, the checks that failed:

    payload (no answers), desconocida (a key that no name is close to), lista (a
    feature's list longer than one), falta (a feature without a value),
    respuesta (a value off the scale), and the user fields' own codes.
    """
    user = ["nombre", "edad", "distrito", "nivel_educativo", "situacion_laboral"]
    rows = docs.select("id", "time", F.to_json("data").alias("datos"), *[F.col(f"user_info.{c}").alias(c) for c in user],
                       R.named_entries(F.coalesce("data", F.create_map().cast(files.REQUEST_SCHEMA["data"].dataType)), NAMES).alias("entries"))
    rows = rows.withColumns({c: P.first_value(R.last_entry(F.col("entries"), c)["values"]) for c in fixed.ITEM_CODES})
    items = F.array(*[F.col(c) for c in fixed.ITEM_CODES])
    asked = lambda e: e["code"].isNotNull() & (e["code"] != PAYMENT)
    checks = [
        F.when(F.size("entries") == 0, F.lit("payload")),
        F.when(F.exists("entries", lambda e: e["code"].isNull()), F.lit("desconocida")),
        F.when(F.exists("entries", lambda e: asked(e) & (F.size(e["values"]) > 1)), F.lit("lista")),
        F.when(F.exists(items, lambda x: x.isNull()), F.lit("falta")),
        F.when(F.exists(items, lambda x: x.isNotNull() & ~x.isin(fixed.LIKERT_LEVELS)), F.lit("respuesta")),
    ]
    codes = F.concat(P.validation_codes(situacion="situacion_laboral"), F.array_compact(F.array(*checks)))
    return rows.withColumn("codes", codes).drop("entries")


def score_requests(docs: DataFrame, model: S.Loaded) -> DataFrame:
    """T1 body: every document with its score, tier and explanation, or with the
    codes of the checks it failed (then it has no score)."""
    rows = aligned(docs).withColumn("nivel", F.col("nivel_educativo")).withColumn("usuario_id", F.col("id"))
    rows = rows.withColumn("respuestas", F.struct(*fixed.ITEM_CODES))
    scored = model.score(rows).withColumn("p_default", F.col("p"))
    scored = C.with_policy(scored, "p_default").withColumn("explicacion", S.explanation(model.features, model.header, fixed.TOP_FEATURES))
    valid = F.size("codes") == 0
    decided = ["p_default", "estado", "tramo", "monto", "model_version", "explicacion"]
    return scored.select("id", "usuario_id", "time", "datos", "nombre", "edad", "distrito", "nivel_educativo", "situacion_laboral", "respuestas",
                         *[F.when(valid, F.col(c)).alias(c) for c in decided], valid.alias("valido"), F.array_join("codes", ",").alias("errores"))


# ---------------------------------------------------------------- T2
def survivors(batch: DataFrame) -> DataFrame:
    """One row per submission id: the earliest, then the least by its fields'
    hash, so that a replay keeps the same one."""
    rank = F.struct(F.col("time").isNull(), "time", F.xxhash64(F.to_json(F.struct(*batch.columns))))
    return batch.groupBy("id").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "id"]), rank).alias("_r")).select("id", "_r.*")


def commit_path(base: str, batch_id: int) -> str:
    return f"{base}/commits/batch_id={int(batch_id)}"


def write_batch(batch: DataFrame, batch_id: int, base: str) -> None:
    """T2 body: valid rows to three tables, the others to quarantine, then the
    commit. The rows are persisted once and feed all writes, then released; a
    lost executor only means its blocks are recomputed."""
    spark = batch.sparkSession
    if files.finished(spark, commit_path(base, batch_id)):
        return
    rows = survivors(batch)
    stored = committed(spark, base, "evaluations")
    if stored is not None:
        rows = rows.join(stored.select("id"), "id", "left_anti")
    b = rows.persist()
    try:
        for name, cols in TABLES.items():
            part = b.where("not valido" if name == "quarantine" else "valido")
            part.select(*cols).write.mode("overwrite").parquet(f"{base}/{name}/batch_id={int(batch_id)}")  # the whole folder, though it may be empty
        counts = b.agg(F.count_if("valido").alias("validos"), F.count_if(~F.col("valido")).alias("cuarentena"))
        counts.write.mode("overwrite").parquet(commit_path(base, batch_id))
    finally:
        b.unpersist()


def committed(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """A table's rows of committed batches, None before there are any. Only the
    folders of committed batches are listed and read."""
    folders = [f"{base}/{name}/{p.rsplit('/', 1)[1]}" for p in files.finished_under(spark, f"{base}/commits", "batch_id")]
    return spark.read.option("basePath", f"{base}/{name}").parquet(*folders) if folders else None


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table's rows of committed batches; without any, none, but with columns."""
    found = committed(spark, base, name)
    if found is not None:
        return found
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*TABLES[name], "batch_id"]]))


def run_stream(spark: SparkSession, source_dir: str, model: S.Loaded, base: str, max_files_per_trigger: int | None = None) -> None:
    """Drain the folder of request documents once (``availableNow``)."""
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_requests(reader.json(source_dir), model)
    q = (scored.writeStream.foreachBatch(lambda df, epoch: write_batch(df, epoch, base))
         .option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
