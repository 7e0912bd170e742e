"""Mixing sources to target weights by capped water-filling (op 4).

The mix takes ``budget`` times all words. Sources have weights; each source's
target is its weight's part of the budget, clamped at ``epochs`` times the
source's words, and the excess is shared again by weight among the sources
that are not clamped, until none is above. A source then takes every document
``floor(target / size)`` times whole and a part of it once more: documents in
seeded order until the rest of the target is used up, the last one in part. So
the words taken are the target, to the nearest word, and no document exceeds
``epochs`` repetitions.

Only DataFrame functions are used. The seeded order is an MD5 of seed and id.
Its running sum is taken over ``16 ** DIGITS`` hash buckets per source and then
over the rows inside each bucket, so that a source with a third of all rows is
never one group. Sources are numbered by ranges: inside each, and by the
running count of the ranges, so that a source per domain is no one-task sort.

Cases: null and blank texts have size 0 and take 0 words; null is a source of
its own, last in order; repeated rows share the id's place in the order and
are then ordered by text, equal ones being interchangeable; a budget above
``epochs`` leaves all sources clamped; an empty table gives an empty result;
other columns are not read by ``mix`` and kept by ``mixed_documents``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import cut_lineage, packed, shuffle_partitions, unpacked

#: Hex digits of the seeded order that a bucket takes: 16 ** DIGITS for each source.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(buckets: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """key, source_size, weight of ``buckets`` (key, n): one row per source,
    weighted by turns in the order of their keys."""
    total = buckets.groupBy("key").agg(F.sum("n").alias("source_size"))
    ranged = cut_lineage(total.repartitionByRange(shuffle_partitions(total.sparkSession), "key").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # as many rows as there are shuffle partitions, at most
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    place = F.col("before") + inside
    turn = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1)
    return ranged.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("key", "source_size", turn.alias("weight"))


def water_fill(sources: DataFrame, budget: float, epochs: float) -> DataFrame:
    """``sources`` (source_size, weight and others) with a ``target`` column.

    Each round clamps the sources whose share is above their cap and shares
    the rest again; a round needs three sums, and clamps one source at least.
    """
    sources = cut_lineage(sources)
    cap, level, clamped = F.col("source_size") * F.lit(float(epochs)), None, None
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        r = sources.agg(F.sum("source_size").alias("s"), F.sum(F.when(over, F.col("source_size"))).alias("full"),
                        F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        whole = float(r.s or 0) * budget
        if r.n == clamped or not r.w:
            break
        clamped, level = r.n, (whole - float(r.full or 0) * epochs) / float(r.w)
    share = F.col("weight") * F.lit(level if level is not None else 0.0)
    return sources.withColumn("target", F.least(share, cap))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, epochs: float = 2.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, more, tie, taken of
    every row (tie: a hash of the text).

    ``taken`` = repeats * size + the words of a last partial repetition.
    """
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    # keys sort as sources do, by code point, and null comes last
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    sizes = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), size_of(text).alias("size"),
                                    F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("order"),
                                    F.xxhash64(text).alias("tie"))).withColumn("bucket", F.substring("order", 1, DIGITS))
    buckets = cut_lineage(sizes.groupBy("key", "bucket").agg(F.sum("size").alias("n")))
    filled = water_fill(source_sizes(buckets, weights), budget, epochs)
    plan = (filled.withColumn("repeats", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long"))
            .withColumn("rest", F.round(F.col("target")).cast("long") - F.col("repeats") * F.col("source_size")).drop("weight"))
    # the room that is left where a bucket begins, then where a row begins
    above = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.join(plan, "key").select("key", "bucket", "source_size", "target", "repeats", (F.col("rest") - F.coalesce(F.sum("n").over(above), F.lit(0))).alias("left"))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = sizes.join(buckets, ["key", "bucket"]).withColumn("more", F.greatest(F.lit(0).cast("long"), F.least("size", room)))
    name = F.when(F.col("key").startswith("0"), F.expr("substring(key, 2)"))
    return rows.select("doc_id", name.alias("source"), "size", "source_size", "target", "repeats", "more", "tie",
                       (F.col("repeats") * F.col("size") + F.col("more")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row per whole repetition,
    and one with the first words of the text per partial one. Blank texts, of
    which nothing can be taken, go.

    Equal rows share one plan row; what it grants beyond whole repetitions is
    dealt to them in turn. The caller's columns travel as one struct.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    plan = plan.groupBy(_row_key("doc_id", "source", F.col("tie")).alias("key")).agg(F.first("size").alias("size"), F.first("repeats").alias("repeats"), F.sum("more").alias("more"))
    text = F.col(text_col).cast("string")
    rows = docs.select(_row_key(id_col, source_col, F.xxhash64(text)).alias("key"), text.alias("text"),
                       packed(docs, text_col).alias("row"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - turn * F.col("size")))
    rows = rows.join(plan, "key").withColumn("part", part).where("size > 0")
    copies = F.col("repeats") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("part").cast("int")), "")
    text = F.when((F.col("copy") > F.col("repeats")) & (F.col("part") < F.col("size")), cut).otherwise(F.col("text"))
    return rows.select(*unpacked(docs, text_col, "row", text))


def _row_key(id_col: str, source_col: str, tie: Column) -> Column:
    return F.md5(F.to_json(F.struct(F.col(id_col).cast("string").alias("a"), F.col(source_col).cast("string").alias("b"), tie.alias("c"))))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('7~' || doc_id) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS j FROM w),
c AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS whole,
             coalesce(sum(source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0 AS full_before,
             (sum(weight) OVER (ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS w_rest FROM r),
l AS (SELECT (whole - full_before) / w_rest AS lv FROM c WHERE 2.0 * source_size > weight * ((whole - full_before) / w_rest) ORDER BY j LIMIT 1),
p AS (SELECT source, source_size, least(weight * (SELECT lv FROM l), 2.0 * source_size) AS target FROM c),
q AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS repeats FROM p),
t AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.repeats,
             greatest(0, least(d.size, round(q.target)::BIGINT - q.repeats * q.source_size
               - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS more
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT *, repeats * size + more AS taken FROM t
"""
