"""Connected components as Spark joins (helper of the pair operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut_lineage


#: Edges that a task contracts at most on average.
EDGES = 1 << 19


class Forest:
    """Union-find over hashable items; the root is the smallest member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, top = self.up, x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x], x = top, nxt
        return top

    def join(self, a, b) -> bool:
        """True if the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def stars(self) -> Iterator[tuple]:
        for x in list(self.up):
            if (top := self.root(x)) != x:
                yield x, top


def edge_batches(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in pairs:
        a.append(x)
        b.append(y)
        if len(a) == 65536:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])
            a, b = [], []
    if a:
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: no more than its nodes."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            forest.join(u, v)
    yield from edge_batches(forest.stars())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long); the
    component is its smallest node.

    Tasks of at most ``EDGES`` edges contract theirs to stars; one task is the
    whole answer when all edges fit in it. Otherwise large-star and small-star
    rounds follow, each a minimum per node and a join with it, until nothing
    changes: a number of rounds logarithmic in the longest path. A hub's edges
    meet one row per node, which Spark's skew join may split.
    """
    def bigger_first(df: DataFrame) -> DataFrame:
        return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now, was = cut_lineage(edges.select("u", "v")), None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())
        if state == was:
            break
        tasks = -(-state[0] // EDGES) or 1
        stars = now.coalesce(tasks).mapInArrow(_contract, "u long, v long")
        if tasks == 1:
            now = cut_lineage(stars)
            break
        was = state
        now = bigger_first(stars)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut_lineage(bigger_first(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
