"""The registered queries of this package: thin applications of its operators
to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import exact_dedup as op10
from scorelake.llm import hard_negatives as op12
from scorelake.llm import importance as op13
from scorelake.llm import language as op7
from scorelake.llm import licenses as op9
from scorelake.llm import mixing as op4
from scorelake.llm import near_join as op1
from scorelake.llm import order_minhash as op5
from scorelake.llm import ppm as op11
from scorelake.llm import quality as op8
from scorelake.llm import repeats as op2
from scorelake.llm import sentencepiece_fst as op6
from scorelake.llm import warc as op3
from scorelake.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op10_exact_dedup", op10.ORACLE_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.language_id(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_mixing", op4.ORACLE_SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op4.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, epochs=2.0)
    return mixed.drop("tie")


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.scan(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.round_trip(table(spark, sf_dir, "documents"))


@query("op3_warc_salvage", op3.ORACLE_SQL)
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.through_archives(spark, table(spark, sf_dir, "pages"), min_bytes=0)


@query("op5_order_minhash")
def order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.fingerprints(table(spark, sf_dir, "documents"))


@query("op1_near_join")
def near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.near_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_ppm_scoring", op11.ORACLE_SQL)
def ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.score(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", op12.ORACLE_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_importance_resampling", op13.ORACLE_SQL)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
