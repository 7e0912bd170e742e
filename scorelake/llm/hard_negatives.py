"""Hard negatives by inner product, found with cover trees (op 12).

Candidates get one more component that gives them all the same norm M, the
largest of any; an anchor gets a 0 there. Then the order by inner product is
the order by angle, and a node that covers its candidates within angle r of its
centre, an angle t from the anchor, bounds their inner products::

    |anchor| M cos(t + r) <= anchor * candidate <= |anchor| M cos(t - r)

(t + r cut at 180 and t - r at 0 degrees). Nodes form a cover tree: a node's
children have centres among its own candidates, the first of them its own
centre, each farther from the others than the level's covering radius, and
every candidate is within that radius of its child's centre. The radius of a
level is the one at which ``FAN`` such centres cover the node.

The top level is global: ``PIVOTS`` centres at most, fitted on the ``SAMPLE``
rows of the least hashes of their ids, with the covering radius of all rows
that lie nearest to each. A cell is dealt by hash to shards of about ``SHARD``
rows, so that a cell of copies is no hot key; a task holds one shard and its
tree, and queries stream past it. Queries visit the shard with the highest
bound first; only shards whose bound reaches the result so far, and whose range
meets a window, get them in the second round. Inside a shard queries descend
level by level, then open leaves best first, in growing numbers: nodes outside
every window and below the result so far are skipped, leaves are verified by
exact inner products. The pivots only steer: the result is exact.

``search`` is the general operator (windowed top k by inner product, among rows
of the same or of another label); ``mine`` applies it twice.

Cases: rows with a null id, label or vector, a null or non-finite component, or
a vector whose inner product with itself exceeds a long take no part; shorter
vectors count as if zeros followed; rows that repeat an id count once (that with
the smallest label, then vector); equal vectors and scores are ordered by id;
zero vectors score 0; other columns are not read; an empty table, or one label,
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import cut_lineage, shuffle_partitions

#: Rows of a shard, children of a node, candidates of a leaf, queries at a time.
SHARD, FAN, LEAF, BLOCK = 8192, 16, 128, 512
#: Global centres at most, and rows that they are fitted on.
PIVOTS, SAMPLE = 256, 4096
#: Room for rounding in angles, as a share of |anchor| M.
SLACK = 1e-6
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """id, label, vec (whole numbers floor(scale * component), as doubles) of
    the rows that take part, one row per id."""
    vec = F.col("vec")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where("id is not null and label is not null and vec is not null")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e18))
    rows = rows.where(~F.coalesce(bad, F.lit(True))).withColumn("vec", F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    rows = rows.where(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x) < float(1 << 62))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("m")).select("id", "m.*")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a batch as rows of ``dim`` components, zeros at the end."""
    off = column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
    flat, length = column.flatten().to_numpy(zero_copy_only=False), np.diff(off)
    if (length == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), length), np.arange(len(flat)) - np.repeat(off[:-1], length)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in floating point while
    no sum can leave the whole doubles, else in 64-bit numbers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.sqrt(np.square(a).sum(1).max() * np.square(b).sum(1).max()) < EXACT / 2:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Cover:
    """Unit vectors of candidates in the augmented space."""

    most: float  # the largest norm

    def unit(self, vec: np.ndarray) -> np.ndarray:
        out = np.empty((len(vec), vec.shape[1] + 1))
        scale = self.most or 1.0
        out[:, :-1] = vec / scale
        out[:, -1] = np.sqrt(np.maximum(0.0, 1.0 - np.square(out[:, :-1]).sum(1)))
        return out

    def bounds(self, query: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of inner products of queries (rows) with what
        lies within ``radius`` (angle) of the centres (columns)."""
        scale = (norm * self.most)[:, None]
        angle = np.arccos(np.clip(query @ centre[:, :-1].T / np.where(norm > 0, norm, 1.0)[:, None], -1.0, 1.0))
        room = SLACK * scale + 1e-6
        return scale * np.cos(np.minimum(np.pi, angle + radius)) - room, scale * np.cos(np.maximum(0.0, angle - radius)) + room


def farthest_first(points: np.ndarray, count: int, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Up to ``count`` centres, each the point farthest from those before it;
    with the place of every point's centre and its cosine to it."""
    centres = [first]
    best, owner = points @ points[first], np.zeros(len(points), np.int64)
    while len(centres) < count:
        far = int(best.argmin())
        if best[far] >= 1.0 - 1e-12:
            break
        near = points @ points[far]
        owner[near > best] = len(centres)
        best = np.maximum(best, near)
        centres.append(far)
    return centres, owner, best


class Tree:
    """A shard's cover tree: levels of (centre, radius, parent), and leaves of
    consecutive candidates."""

    def __init__(self, cover: Cover, ids: np.ndarray, label: np.ndarray, vec: np.ndarray):
        unit = cover.unit(vec)
        order = np.arange(len(ids))
        parts = [(0, len(ids), 0)]  # of ``order``: begin, end, the place of the centre
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parents = [-1]
        while True:
            centres, radii = [], []
            for a, b, c in parts:
                cosine = unit[order[a:b]] @ unit[order[c]]
                centres.append(unit[order[c]])
                radii.append(float(np.arccos(np.clip(cosine.min(), -1.0, 1.0))) + 1e-7)
            self.levels.append((np.array(centres).reshape(len(parts), -1), np.array(radii), np.array(parents)))
            if all(b - a <= LEAF for a, b, _ in parts):
                break
            below, parents = [], []
            for p, (a, b, c) in enumerate(parts):
                own = order[a:b]
                if b - a <= LEAF:
                    below.append((a, b, c))
                    parents.append(p)
                    continue
                chosen, owner, _ = farthest_first(unit[own], FAN, c - a)
                if len(chosen) == 1:  # copies of one vector: leaves by number
                    owner = np.arange(b - a) // LEAF
                at = np.argsort(owner, kind="stable")
                order[a:b] = own[at]
                ends = a + np.cumsum(np.bincount(owner))
                place = np.empty(b - a, np.int64)
                place[at] = np.arange(b - a)
                for k, (x, y) in enumerate(zip([a, *ends[:-1]], ends)):
                    below.append((int(x), int(y), int(a + place[chosen[k]]) if len(chosen) > 1 else int(x)))
                    parents.append(p)
            parts = below
        self.cover, self.leaves = cover, [(a, b) for a, b, _ in parts]
        self.ids, self.label, self.vec = ids[order], label[order], vec[order]

    def search(self, ids: np.ndarray, label: np.ndarray, vec: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray, same: bool, k: int):
        """(query, window, score, id) of the top k of each window [low, high]
        (queries by windows), unless they lie below ``reach``."""
        norm = np.sqrt(np.square(vec).sum(1))
        reach = np.maximum(reach, low)
        upper = None
        for centre, radius, parent in self.levels:
            lo, up = self.cover.bounds(vec, norm, centre, radius)
            if upper is not None:
                up = np.minimum(up, upper[:, parent])
            dead = (lo > high.max(1)[:, None]) | (up < reach.min(1)[:, None])  # outside every window
            upper = np.where(dead, -np.inf, up)
        turn = np.argsort(-upper, axis=1, kind="stable")  # leaves of each query, best first
        found = [np.zeros(0, np.int64)] * 4
        a, step = 0, 1
        while a < turn.shape[1]:
            opened = turn[:, a: a + step]
            live = (upper[np.arange(len(vec))[:, None], opened] >= reach.min(1)[:, None])
            if not live.any():
                break
            who, which = np.nonzero(live)
            leaf = opened[who, which]
            by = np.argsort(leaf, kind="stable")
            who, leaf = who[by], leaf[by]
            parts = [found]
            for x, y in zip(*(lambda c: (np.concatenate(([0], c)), np.concatenate((c, [len(leaf)]))))(np.flatnonzero(np.diff(leaf)) + 1)):
                parts.append(self._open(self.leaves[leaf[x]], who[x:y], ids, label, vec, low, high, reach, same, k))
            found = _best([np.concatenate(c) for c in zip(*parts)], k)
            slot = found[0] * low.shape[1] + found[1]
            full = np.flatnonzero(np.diff(slot, append=-1))
            full = full[np.bincount(slot, minlength=low.size)[slot[full]] >= k]
            kth = np.full(low.size, LEAST)
            kth[slot[full]] = found[2][full]
            reach = np.maximum(reach, kth.reshape(low.shape))
            a, step = a + step, 2 * step
        return found

    def _open(self, leaf: tuple[int, int], who, ids, label, vec, low, high, reach, same, k):
        a, b = leaf
        score = products(vec[who], self.vec[a:b])
        ok = (label[who][:, None] == self.label[a:b]) == same
        ok &= ids[who][:, None] != self.ids[a:b]
        out = []
        for w in range(low.shape[1]):
            hit = ok & (score >= reach[who, w][:, None]) & (score <= high[who, w][:, None])
            if b - a > k and hit.any():  # what is below the leaf's own k-th can't be in the result
                kth = -np.partition(np.where(hit, -score, MOST), k - 1, axis=1)[:, k - 1]
                hit &= score >= np.where(kth == -MOST, LEAST, kth)[:, None]
            q, c = np.nonzero(hit)
            out.append((who[q], np.full(len(q), w), score[q, c], self.ids[a:b][c]))
        return [np.concatenate(c) for c in zip(*out)]


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The top k (score down, id up) of each query and window, in that order."""
    q, w, score, ids = found
    order = np.lexsort((ids, -score, w, q))
    q, w = q[order], w[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (w[1:] != w[:-1])
    start = np.flatnonzero(first)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = order[place < k]
    return [c[keep] for c in found]


@dataclass
class Index:
    """The global level, and all rows with their shards."""

    rows: DataFrame  # id, label, vec, shard
    cover: Cover
    dim: int
    centres: np.ndarray  # unit vectors
    radius: np.ndarray  # angles
    shards: np.ndarray  # of each cell


def build_index(rows: DataFrame) -> Index:
    """Index all of ``rows`` (id, label, vec; see ``usable``)."""
    rows = cut_lineage(rows)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"),
                     F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    cover, dim = Cover(float(np.sqrt(total.square or 0.0)) * (1 + 1e-12)), int(total.dim or 0)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()  # a bounded sample steers the search
    points = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        points[i, : len(r.vec)] = r.vec
    points = cover.unit(points)
    chosen = farthest_first(points, min(PIVOTS, -(-total.n // SHARD)))[0] if len(points) else []
    centres = points[chosen]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = cover.unit(_matrix(batch.column("vec"), dim)) @ centres.T
            cell = cosine.argmax(1)
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(cosine[np.arange(len(cell)), cell])], ["id", "label", "vec", "cell", "cosine"])

    placed = cut_lineage(rows.mapInArrow(place, "id long, label long, vec array<double>, cell int, cosine double"))
    radius, shards = np.zeros(len(chosen)), np.zeros(len(chosen), np.int64)
    for r in placed.groupBy("cell").agg(F.min("cosine").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # PIVOTS rows at most
        radius[r.cell], shards[r.cell] = np.arccos(np.clip(r.far, -1.0, 1.0)) + 1e-7, -(-r.n // SHARD)
    salts = F.element_at(F.array(*[F.lit(int(max(1, s))) for s in shards] or [F.lit(1)]), F.col("cell") + 1)
    shard = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(3)), salts)
    return Index(placed.select("id", "label", "vec", shard.alias("shard")), cover, dim, centres, radius, shards)


_QUERY = "id long, label long, vec array<double>, low array<long>, high array<long>, reach array<long>"


def _route(index: Index, home: bool):
    """Queries to shards: the one of the highest bound, or all others whose
    bounds meet a window and reach the result so far."""
    cover, dim, centres, radius, shards = index.cover, index.dim, index.centres, index.radius, index.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                batch = big.slice(at, BLOCK)
                vec = _matrix(batch.column("vec"), dim)
                lo, up = cover.bounds(vec, np.sqrt(np.square(vec).sum(1)), centres, radius)
                ids = batch.column("id").to_numpy()
                best = up.argmax(1)
                first = (ids * 2654435761 % (1 << 31)) % np.maximum(shards[best], 1)
                if home:
                    who, shard = np.arange(len(ids)), best * (1 << 32) + first
                    yield _sent(batch, who, shard)
                    continue
                reach, high = (np.array(batch.column(c).to_pylist(), np.float64).reshape(len(ids), -1) for c in ("reach", "high"))
                open_ = (up >= reach.min(1)[:, None]) & (lo <= high.max(1)[:, None])
                for cell in np.flatnonzero(open_.any(0)):
                    who = np.flatnonzero(open_[:, cell])
                    for salt in range(int(shards[cell])):
                        mine = who[(best[who] != cell) | (first[who] != salt)]
                        if len(mine):
                            yield _sent(batch, mine, np.full(len(mine), cell * (1 << 32) + salt))
    return run


def _sent(batch: pa.RecordBatch, who: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    rows = batch.take(pa.array(who))
    return pa.record_batch([*rows.columns, pa.array(shard.astype(np.int64))], ["id", "label", "vec", "low", "high", "reach", "shard"])


def _visit(index: Index, same: bool, k: int):
    """A partition's shards in turn: candidates (side 0) become a tree, which
    the shard's queries (side 1) search block by block."""
    cover, dim = index.cover, index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, held = None, None, []
        for big in batches:
            shard, side = big.column("shard").to_numpy(), big.column("side").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(shard) != 0) | (np.diff(side) != 0)) + 1, [big.num_rows]))
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                if shard[x] != at:
                    at, tree, held = shard[x], None, []
                if side[x] == 0:
                    held.append(big.slice(x, y - x))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = Tree(cover, *(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "label")),
                                np.concatenate([_matrix(b.column("vec"), dim) for b in held]))
                    held = []
                for a in range(x, y, BLOCK):
                    part = big.slice(a, min(BLOCK, y - a))
                    windows = [np.array(part.column(c).to_pylist(), np.int64).reshape(part.num_rows, -1) for c in ("low", "high", "reach")]
                    ids = part.column("id").to_numpy()
                    q, w, score, other = tree.search(ids, part.column("label").to_numpy(), _matrix(part.column("vec"), dim), *windows, same, k)
                    yield pa.record_batch([pa.array(ids[q]), pa.array(w.astype(np.int32)), pa.array(score), pa.array(other)], ["id", "w", "score", "other"])
    return run


def _round(index: Index, queries: DataFrame, home: bool, same: bool, k: int) -> DataFrame:
    sent = queries.mapInArrow(_route(index, home), _QUERY + ", shard long").withColumn("side", F.lit(1))
    none = F.lit(None).cast("array<long>")
    held = index.rows.select("id", "label", "vec", none.alias("low"), none.alias("high"), none.alias("reach"), "shard", F.lit(0).alias("side"))
    rows = held.unionByName(sent).repartition(shuffle_partitions(queries.sparkSession), "shard").sortWithinPartitions("shard", "side")
    return rows.mapInArrow(_visit(index, same, k), "id long, w int, score long, other long")


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id", "w").orderBy(F.col("score").desc(), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search(index: Index, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """id, w, place, score, other: for every query (id, label, vec, and arrays
    low and high of its windows; one row per id) and window w the k rows of the
    index, of the same label or of another, with the highest inner products
    within [low, high]; ties to the smaller id, the query's own row left out."""
    queries = cut_lineage(queries.withColumn("reach", F.col("low")).select("id", "label", "vec", "low", "high", "reach"))
    first = cut_lineage(_round(index, queries, True, same, k))
    # what the first visit has for sure: the k-th score of each window
    sure = _top(first, k).where(F.col("place") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    reach = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w.cast("int")), x)))
    rest = queries.join(sure, "id", "left").withColumn("reach", reach).drop("kth")
    return _top(first.unionByName(_round(index, rest, False, same, k)), k)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for anchors (ids divisible by ``every``) and their best
    ``positives`` rows of the same label, the best ``negatives`` rows of another
    with ``low`` to ``high`` percent of the positive's score."""
    index = build_index(rows)
    anchors = index.rows.where(F.col("id") % every == 0).select("id", "label", "vec")
    whole = [F.array(F.lit(v).cast("long")).alias(c) for v, c in ((LEAST + 1, "low"), (MOST, "high"))]
    liked = cut_lineage(search(index, anchors.select("*", *whole), True, positives))
    # whole numbers: score * high / 100 rounded down, score * low / 100 rounded up, without leaving 64 bits
    share = lambda percent: F.floor(F.col("score").cast("decimal(20,0)") * percent / 100).cast("long")
    top, bottom = share(high), -F.floor(-F.col("score").cast("decimal(20,0)") * low / 100).cast("long")
    windows = liked.select("id", "place", "score", "other", bottom.alias("low"), top.alias("high")).where("low <= high")
    listed = windows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("p"))  # ``positives`` at most
    queries = anchors.join(listed, "id").select("id", "label", "vec", F.col("p.low").alias("low"), F.col("p.high").alias("high"), "p")
    # windows of an anchor are padded to the same number, so that a block of queries is one table
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.lit(positives) - F.size(c)))
    padded = queries.withColumn("low", pad("low", MOST)).withColumn("high", pad("high", LEAST + 1)).drop("p")
    found = search(index, padded, False, negatives)
    numbered = windows.select("id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"),
                              (F.row_number().over(Window.partitionBy("id").orderBy("place")) - 1).alias("w"))
    return found.join(numbered, ["id", "w"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"),
                                                    F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine`` with the labels of ids divisible by 7 moved on by one, of ten."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(usable(embeddings.select("vec_id", "embedding", label.alias("label"))))


ORACLE_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id != b.id WHERE a.id % 50 = 0),
q AS (SELECT a, b, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT q.a, q.b AS positive_id, q.score AS positive_score, p.b AS negative_id, p.score AS negative_score,
             row_number() OVER (PARTITION BY q.a, q.b ORDER BY p.score DESC, p.b) AS rank
      FROM q JOIN p ON p.a = q.a AND NOT p.same AND 50 * q.score <= 100 * p.score AND 100 * p.score <= 95 * q.score)
SELECT a AS anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
