"""Exact k nearest neighbours in L1, of any number of features, without a cross
join and without a group that holds all rows (M8).

Points are profiles with a count of rows. ``PIVOTS`` of them at most, fitted on
a bounded sample, cut the space into cells (each point goes to its nearest
pivot); a cell is dealt by hash to blocks of about ``block`` points, or more
where that makes more than ``BLOCKS``, so a dense cell is no hot key. A point x
of pivot p's cell is at least |d(q, p) - d(p, x)| away from q, so at least
d(q, p) - radius(p), the cell's largest distance. The search has two rounds:

1. every point looks into its own block; the distance within which it finds k
   rows there bounds its result;
2. a point travels to those other blocks whose lower bound does not exceed the
   largest such distance of the block's points.

Points that do not travel to a block are farther than the k-th neighbour of all
in it, so each result is certified; the pivots only save visits. In features
without structure few are saved, and the work is that of all pairs, in tasks of
one block each. Points stream past a block's own, the queries; a task holds one
block and the k best of each, so no pair becomes a row.

Most pairs are only bounded (``Space``): features of few values make a product
of two matrices in 32 bits, and the pairs within a query's k-th distance, plus
what rounding may add, get the sum feature by feature that decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PIVOTS, SAMPLE, BLOCK, QUERIES = 256, 4096, 2048, 256
#: Blocks that points are dealt to, as long as they have ``LARGE`` points at most.
BLOCKS, LARGE = 64, 1 << 16
#: Values that a feature of the matrix product has at most.
LEVELS = 32
#: Rows of a distance matrix that are worked on at a time; queries and points of a matrix product.
ROWS, TILE, POINTS = 16, 512, 1024
_SLACK = 1e-9
_FOUND = "pid string, nid string, dist double, avail long"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distances of rows, added feature by feature in order; ``ROWS`` of them
    at a time, in one buffer that stays in a core's cache."""
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    held = np.empty((min(ROWS, len(a)), len(b)))
    for x in range(0, len(a), ROWS):
        part = out[x:x + ROWS]
        gap = held[:len(part)]
        for d in range(a.shape[1]):
            np.subtract(a[x:x + ROWS, d, None], columns[d], out=gap)
            np.abs(gap, out=gap)
            part += gap
    return out


def _pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` points, each the farthest from those before it."""
    chosen, least = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _nearest(ids: np.ndarray, vec: np.ndarray, others: np.ndarray, place: np.ndarray, count: np.ndarray, at: dict[str, list[int]], k: int):
    """(query's place, other's place, distance, rows) of each query's nearest
    ``k`` others that have a row to give, ties by id; ``at``: an other's places."""
    dist = distances(vec, place)
    mine = np.array([(q, o) for q, x in enumerate(ids) for o in at.get(x, ())], np.int64).reshape(-1, 2)
    dist[:, count <= 0] = np.inf
    dist[mine[:, 0], mine[:, 1]] = np.where(count[mine[:, 1]] > 1, dist[mine[:, 0], mine[:, 1]], np.inf)
    if dist.shape[1] > k:
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
        q, o = np.nonzero((dist <= kth[:, None]) & np.isfinite(dist))
    else:
        q, o = np.nonzero(np.isfinite(dist))
    order = np.lexsort((others[o], dist[q, o], q))
    q, o = q[order], o[order]
    first = np.searchsorted(q, np.arange(len(ids)))
    keep = np.arange(len(q)) - first[q] < k
    q, o = q[keep], o[keep]
    return q, o, dist[q, o], count[o] - (ids[q] == others[o])


class Space:
    """L1 distances in 32 bits. A feature of the sorted values v adds
    |x - y| = sum of gaps (1 - s(x) s(y)) / 2 over its gaps, s telling by 1 and -1
    on which side of the gap a value is; a feature without values its difference."""

    def __init__(self, dims: int, values: dict[int, list[float]], low: list[float], high: list[float]):
        self.dims, self.low = dims, np.array(low)
        self.cuts = [(f, np.sort(np.array(v, float))[:-1]) for f, v in sorted(values.items()) if len(v) > 1]
        self.half = np.concatenate([np.diff(np.sort(np.array(v, float))) for _, v in sorted(values.items()) if len(v) > 1] or [np.zeros(0)]).astype(np.float32) / 2
        self.loose = [f for f in range(dims) if f not in values]
        self.most = float(self.half.sum(dtype=float))
        spread = 2 * self.most + float(sum(high[f] - low[f] for f in self.loose))
        self.slack = (len(self.half) + 4 * len(self.loose) + 16) * 2.0 ** -22 * spread + _SLACK

    def sides(self, vec: np.ndarray) -> np.ndarray:
        out = np.empty((len(vec), len(self.half)), np.float32)
        at = 0
        for f, cuts in self.cuts:
            out[:, at:at + len(cuts)] = np.where(vec[:, f, None] > cuts, 1, -1)
            at += len(cuts)
        return out

    def rest(self, vec: np.ndarray) -> np.ndarray:
        """The other features, one a row."""
        return np.ascontiguousarray((vec - self.low)[:, self.loose].T.astype(np.float32))

    def within(self, sides: np.ndarray, rest: np.ndarray, other: np.ndarray, other_rest: np.ndarray, reach: np.ndarray):
        """Pairs (row, other row) that may lie within the row's ``reach``."""
        near = sides @ other.T
        for x, y in zip(rest, other_rest):
            gap = x[:, None] - y
            near -= np.abs(gap, out=gap)
        at = np.flatnonzero(near >= (self.most - reach - self.slack).astype(np.float32)[:, None])
        return at // len(other), at % len(other)


class _Search:
    """A block's queries and the ``k`` nearest of what has come by, ties by id."""

    def __init__(self, space: Space, k: int, parts: list[pa.RecordBatch]):
        self.space, self.k = space, k
        self.ids = np.concatenate([np.array(x.column("pid").to_pylist(), object) for x in parts])
        self.vec = np.concatenate([_matrix(x.column("vec"), space.dims) for x in parts])
        self.reach = np.concatenate([x.column("reach").to_numpy(zero_copy_only=False) for x in parts]).astype(float)
        self.whole = np.isfinite(self.vec).all(1)
        self.sides, self.rest = space.sides(self.vec), space.rest(self.vec)
        n = len(self.ids)
        self.dist, self.near, self.avail = np.full((n, k), np.inf), np.full((n, k), None, object), np.zeros((n, k), np.int64)

    def see(self, part: pa.RecordBatch) -> None:
        ids, vec, count = np.array(part.column("pid").to_pylist(), object), _matrix(part.column("vec"), self.space.dims), part.column("c").to_numpy()
        good = (count > 0) & np.isfinite(vec).all(1)
        ids, vec, count = ids[good], vec[good], count[good]
        if not len(ids):
            return
        far = np.flatnonzero(self.whole & np.isinf(self.reach))
        known = np.flatnonzero(self.whole & np.isfinite(self.reach))  # before what the others find here
        if len(far):
            at: dict[str, list[int]] = {}
            for i, pid in enumerate(ids):
                at.setdefault(pid, []).append(i)
            for x in range(0, len(far), QUERIES):
                rows = far[x:x + QUERIES]
                q, o, dist, avail = _nearest(self.ids[rows], self.vec[rows], ids, vec, count, at, self.k)
                self._keep(rows[q], ids[o], dist, avail)
        sides, rest = self.space.sides(vec) * self.space.half, self.space.rest(vec)
        found = []
        for x in range(0, len(known), TILE):
            rows = known[x:x + TILE]
            q, o = self.space.within(self.sides[rows], self.rest[:, rows], sides, rest, self.reach[rows])
            found.append((rows[q], o))
        if found:
            q, o = (np.concatenate(x) for x in zip(*found))
            dist = np.zeros(len(q))
            for f in range(self.space.dims):
                dist += np.abs(self.vec[q, f] - vec[o, f])
            avail = count[o] - (self.ids[q] == ids[o])
            go = (dist <= self.reach[q]) & (avail > 0)
            self._keep(q[go], ids[o[go]], dist[go], avail[go])

    def _keep(self, q: np.ndarray, ids: np.ndarray, dist: np.ndarray, avail: np.ndarray) -> None:
        if not len(q):
            return
        rows, place = np.unique(q, return_inverse=True)
        place = np.concatenate((np.repeat(np.arange(len(rows)), self.k), place))
        dist, ids, avail = np.concatenate((self.dist[rows].ravel(), dist)), np.concatenate((self.near[rows].ravel(), ids)), np.concatenate((self.avail[rows].ravel(), avail))
        held = np.flatnonzero(np.isfinite(dist))
        order = held[np.lexsort((ids[held], dist[held], place[held]))]
        nth = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        order, nth = order[nth < self.k], nth[nth < self.k]
        to = rows[place[order]], nth
        self.dist[to], self.near[to], self.avail[to] = dist[order], ids[order], avail[order]
        self.reach[rows] = np.minimum(self.reach[rows], self.dist[rows, -1])

    def found(self) -> pa.RecordBatch:
        q, n = np.nonzero(np.isfinite(self.dist))
        return pa.record_batch([pa.array(self.ids[q], pa.string()), pa.array(self.near[q, n], pa.string()), pa.array(self.dist[q, n]), pa.array(self.avail[q, n])], ["pid", "nid", "dist", "avail"])


def _visit(space: Space, k: int):
    """mapInArrow over rows sorted by (block, side): a block's queries (side 0),
    then the points (side 1) that come to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, search = None, [], None
        for batch in batches:
            block, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1, [batch.num_rows]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if block[a] != at:
                    if search:
                        yield search.found()
                    at, parts, search = block[a], [], None
                if side[a] == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                search = search or _Search(space, k, parts)
                for x in range(a, b, POINTS):
                    search.see(batch.slice(x, min(POINTS, b - x)))
        if search:
            yield search.found()
    return run


def _space(base: DataFrame, dims: int) -> Space:
    """What is known of the features: ranges, and the values where they are few."""
    seen = base.select(F.posexplode("vec").alias("f", "v")).where("v is not null and not isnan(v) and abs(v) < double('inf')")
    seen = cut_lineage(seen.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")))
    ranges = {r["f"]: r for r in seen.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    few = [f for f, r in ranges.items() if r["n"] <= LEVELS]
    values: dict[int, list[float]] = {f: [] for f in few}
    for r in (seen.where(F.col("f").isin(few)).collect() if few else []):  # LEVELS a feature at most
        values[r["f"]].append(r["v"])
    return Space(dims, values, [ranges[f]["lo"] if f in ranges else 0.0 for f in range(dims)], [ranges[f]["hi"] if f in ranges else 0.0 for f in range(dims)])


def _take(found: DataFrame, k: int) -> DataFrame:
    """Of the nearest others as many as give ``k`` rows, and how many each gives."""
    w = Window.partitionBy("pid").orderBy("dist", "nid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("avail").over(w), F.lit(0))
    return (found.withColumn("before", before).where(F.col("before") < k)
            .select("pid", "nid", "dist", F.least(F.col("avail"), F.lit(k) - F.col("before")).alias("w")))


def knn(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(pid, nid, dist, w): for every point (pid string, c long, vec
    array<double>, all of one length) its ``k`` nearest rows, itself left out,
    as points with the number of rows taken from each; ties to the smaller id.
    With fewer than ``k`` other rows all are taken."""
    spark = points.sparkSession
    base = cut_lineage(points.select("pid", F.col("c").cast("long").alias("c"), "vec"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    n, dims = total["n"], total["dims"] or 0
    block = max(block, min(LARGE, -(-n // BLOCKS)))
    sample = base.orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE).select("vec").collect()  # bounded; the pivots only steer
    sample = np.array([r["vec"] for r in sample], float).reshape(len(sample), dims)
    sample = sample[np.isfinite(sample).all(1)] if n else sample  # points that lack a value have no neighbours, and don't steer
    pivots = _pivots(sample, min(PIVOTS, -(-n // block))) if len(sample) else np.zeros((min(n, 1), dims))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist = distances(_matrix(batch.column("vec"), dims), pivots)
            cell = dist.argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist[np.arange(len(cell)), cell])], ["pid", "c", "vec", "cell", "away"])

    placed = cut_lineage(base.mapInArrow(place, "pid string, c long, vec array<double>, cell int, away double"))
    radius, blocks = np.zeros(len(pivots)), np.ones(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max(F.nanvl("away", F.lit(0.0))).alias("far"), F.count(F.lit(1)).alias("n")).collect():  # PIVOTS rows at most
        radius[r["cell"]], blocks[r["cell"]] = r["far"], -(-r["n"] // block)
    salts = F.element_at(F.array(*[F.lit(int(b)) for b in blocks] or [F.lit(1)]), F.col("cell") + 1)
    own = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("pid"), salts)
    placed = placed.select("pid", "c", "vec", own.alias("block"))
    tasks, space = int(spark.conf.get("spark.sql.shuffle.partitions")), _space(base, dims)

    def visit(queries: DataFrame, others: DataFrame) -> DataFrame:
        rows = queries.select("block", F.lit(0).alias("side"), "pid", F.lit(0).cast("long").alias("c"), "vec", "reach").unionByName(
            others.select("block", F.lit(1).alias("side"), "pid", "c", "vec", F.lit(0.0).alias("reach")))
        return rows.repartition(tasks, "block").sortWithinPartitions("block", "side").mapInArrow(_visit(space, k), _FOUND)

    first = cut_lineage(visit(placed.withColumn("reach", F.lit(float("inf"))), placed))
    got = _take(first, k).groupBy("pid").agg(F.sum("w").alias("rows"), F.max("dist").alias("far"))
    reach = F.when(F.col("rows") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    asking = cut_lineage(placed.join(got, "pid", "left").select("pid", "vec", "block", F.coalesce(reach, F.lit(float("inf"))).alias("reach")))
    farthest = {r["block"]: r["far"] for r in asking.groupBy("block").agg(F.max("reach").alias("far")).collect()}  # a row a block

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for x in range(0, big.num_rows, QUERIES):
                batch = big.slice(x, QUERIES)
                mine = batch.column("block").to_numpy()
                bound = distances(_matrix(batch.column("vec"), dims), pivots) - radius - _SLACK
                for to, far in farthest.items():
                    go = np.flatnonzero((bound[:, to >> 32] <= far) & (mine != to))
                    if len(go):
                        rows = batch.take(pa.array(go))
                        yield pa.record_batch([rows.column("pid"), rows.column("c"), rows.column("vec"), pa.array(np.full(len(go), to))], ["pid", "c", "vec", "block"])

    second = visit(asking, placed.mapInArrow(others, "pid string, c long, vec array<double>, block long"))
    return _take(first.unionByName(second), k)
