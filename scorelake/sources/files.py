"""File sources and sinks.

Everything is written under the shared checkpoint folder (see
``session.shared_path``) and read back with an explicit schema: no schema
inference job, no machine-local temp folder, no single-file ``coalesce(1)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

TRAINING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("distrito", T.StringType()),
    T.StructField("nivel", T.StringType()),
    T.StructField("tamano", T.LongType()),
    T.StructField("target", T.StringType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("trees_used", T.LongType()),
    T.StructField("auc_train", T.DoubleType()),
    T.StructField("auc_validation", T.DoubleType()),
    T.StructField("auc_test", T.DoubleType()),
    T.StructField("train_test_gap", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision_riesgo", T.DoubleType()),
    T.StructField("recall_riesgo", T.DoubleType()),
    T.StructField("f1_riesgo", T.DoubleType()),
])

USER_INFO = T.StructType([
    T.StructField("nombre", T.StringType()),
    T.StructField("edad", T.LongType()),
    T.StructField("distrito", T.StringType()),
    T.StructField("nivel_educativo", T.StringType()),
    T.StructField("situacion_laboral", T.StringType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("applicant", T.LongType()),
    T.StructField("data", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("user_info", USER_INFO),
])

RUNS_SCHEMA = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


# ---------------------------------------------------------------- S1, S3
def write_csv(df: DataFrame, path: str) -> str:
    """S3: header CSV, UTF-8, one file per task (never funnelled to one)."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV.  With a schema the header is checked against it;
    without one every column is a string named by the header (no inference)."""
    r = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"')
    if schema is not None:
        r = r.schema(schema).option("enforceSchema", False)
    return r.csv(path)


def roundtrip_csv(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    path = write_csv(df, shared_path(df.sparkSession, "csv", name))
    return read_csv(df.sparkSession, path, schema)


# ---------------------------------------------------------------- S4
def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ---------------------------------------------------------------- S5
def request_documents(answers: DataFrame, export: DataFrame, empty_keys: list[str]) -> DataFrame:
    """Request documents ``{applicant, data: map<key, list>, user_info}``.

    ``data`` gathers one applicant's answers (at most one entry per item, so
    the group is bounded by the item count) plus ``empty_keys`` with [].
    """
    entries = answers.groupBy("applicant").agg(
        F.collect_list(F.struct(F.col("key").alias("key"), F.array(F.col("answer")).alias("v"))).alias("_e"))
    empties = F.array(*[F.struct(F.lit(k).alias("key"), F.array().cast("array<string>").alias("v"))
                        for k in empty_keys])
    data = F.map_from_entries(F.concat(F.col("_e"), empties)) if empty_keys else F.map_from_entries("_e")
    info = export.select(
        "applicant",
        F.struct(F.concat(F.lit("Postulante "), F.col("applicant").cast("string")).alias("nombre"),
                 F.col("EDAD").cast("long").alias("edad"),
                 F.col("DISTRITO DE RESIDENCIA").alias("distrito"),
                 F.col("NIVEL EDUCATIVO").alias("nivel_educativo"),
                 F.col("SITUACION LABORAL").alias("situacion_laboral")).alias("user_info"))
    return entries.select("applicant", data.alias("data")).join(info, "applicant")


def flatten_request(docs: DataFrame) -> DataFrame:
    """(applicant, key, first value, list length) + user fields — P9 applied."""
    return docs.select("applicant", "user_info", F.explode("data").alias("key", "valores")).select(
        "applicant", "key", F.get(F.col("valores"), 0).alias("respuesta"),
        F.size("valores").alias("n_valores"),
        F.col("user_info.nombre").alias("nombre"), F.col("user_info.edad").alias("edad"))


# ---------------------------------------------------------------- S8
def save_table_model(card: DataFrame, path: str) -> str:
    card.write.mode("overwrite").parquet(path)
    return path


def load_table_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- S9
def exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist, in whatever file system it names?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


MANIFEST_SCHEMA = "path string, existe boolean, size_kb double, sha256 string"


def artifact_manifest(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """Exists / size KB / SHA-256 per stored file, computed by the executors
    that read the bytes (``binaryFile``), not by a driver-side loop.  A path
    that is not there is one row with ``existe`` false. A file is read whole,
    so it may have 2 GB at most, and an empty one has no row; one whose own checksum fails ends the job, or
    with ``skip_unreadable`` is left out."""
    if not exists(spark, path):
        return spark.createDataFrame([(path, False, None, None)], MANIFEST_SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", skip_unreadable).load(path)
    return files.select(
        F.col("path"), F.lit(True).alias("existe"),
        F.round(F.col("length") / F.lit(1024.0), 2).alias("size_kb"),
        F.sha2(F.col("content"), 256).alias("sha256"))


def artifact_digest(manifest: DataFrame) -> DataFrame:
    """One row for a stored artefact: is it there, its size and a SHA-256 over
    its files' hashes in order (the files of one model)."""
    return manifest.agg(
        F.coalesce(F.bool_and("existe"), F.lit(False)).alias("existe"), F.round(F.sum("size_kb"), 2).alias("size_kb"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("sha256"))


# ---------------------------------------------------------------- S10
def finished(spark: SparkSession, path: str) -> bool:
    """Has a writer finished this folder? Spark's committer leaves ``_SUCCESS``
    when all of a table's files are in place."""
    return exists(spark, f"{path}/_SUCCESS")


def finished_under(spark: SparkSession, base: str, key: str) -> list[str]:
    """The finished folders ``<key>=...`` of a table (their number is that of
    the writes, not of the rows)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{key}=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(str(f.getPath().getParent()) for f in found)


def append_runs(runs: DataFrame, path: str, experiment: str | None = None) -> str:
    """Add an experiment's runs to the registry at ``path``.

    Every experiment is a folder of its own with its own commit, so writers
    never share one; readers see finished folders only. ``experiment`` names it
    (default: a digest of its runs' names, parameters and tags): repeating a
    finished one leaves the registry as it is.
    """
    if experiment is None:
        content = F.to_json(F.struct("run_name", F.sort_array(F.map_entries("params")).alias("p"), F.sort_array(F.map_entries("tags")).alias("t")))
        experiment = runs.agg(F.md5(F.array_join(F.sort_array(F.collect_list(content)), "")).alias("d")).first()["d"]
    folder = f"{path}/experiment={experiment}"
    if not finished(runs.sparkSession, folder):
        runs.write.mode("overwrite").parquet(folder)
    return path


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the finished experiments, with ``experiment``."""
    folders = finished_under(spark, path, "experiment")
    schema = T.StructType([*RUNS_SCHEMA, T.StructField("experiment", T.StringType())])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)
