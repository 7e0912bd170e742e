"""N-gram Jaccard self-join with signature trees (op 1).

Documents are sets of hashed word shingles; two link when their Jaccard
similarity is at least a threshold num/den. The join is carried out in
blocks, and a block is joined by a signature tree:

1. Equal sets are one class (a 128-bit digest); only its smallest id goes on.
2. Blocks. Two similar sets differ in at most d shingles, d given by their
   size class. Cut by hash into d + 1 parts, they agree in one part at least,
   so a set's part hashes (for its own size class and the one below) are the
   keys under which it meets all its partners. An empty part agrees without a
   meeting; where that could matter (few parts), sets with empty parts also
   meet by their smallest shingles, of which similar sets must share one.
   (With 28 parts or more all non-empty ones would each have to hold a
   difference, a chance below 1e-11.) Keys travel packed, a pack's equal keys
   as one, and sets that meet in a size class, directly or through others, form
   a block.
3. Joining. A block with more than ``TILE`` sets is cut into tiles, and all
   tiles are joined with themselves and with each other, so every pair is in
   one tile or pair of tiles. Two sets can meet in the blocks of two size
   classes; they count in that of the smaller set's class.
   Where only one text of each group is wanted (``keep_one_of_each``), the sets of
   such a block first meet once more, by keys that each cover twice as much of a
   set (``finer_keys``): a passage that many texts hold makes a part agree here and
   there, and chains of such meetings grow into blocks of a large share of all
   sets, of which each tile would travel to each other. What then still is large
   gets tiles, with some common pivots and are joined with themselves, and then only those pairs
   of tiles with each other that do not already lie in one component.
4. In a tile sets are sorted by size and packed into a tree. A node holds the
   OR of its members' token bitmaps, their size range and the largest number
   of tokens that share a bit. Node pairs are visited together: a pair whose
   sizes cannot reach the threshold, or whose largest possible overlap (common
   bits plus shared-bit excess) is too small, is pruned (for
   ``keep_one_of_each`` also one that lies in one component already). At the
   leaves bitmaps bound each pair and the sets themselves decide.
5. Links are counted for both ends, weighted by the rows of the other class,
   and make components; copies are never expanded into pairs.

Cases: null texts, and texts without words, have an empty set and link with
nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows with equal ids are one node; a row with a null id takes no part
in links and has a null component and no links; rows with equal ids count as
rows in the number of links; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import chunks, cut_lineage, keyed, lower_ascii, mix64, shuffle_partitions, squeeze, unsqueeze, utf8, word_hashes
from scorelake.llm.components import Forest, components, edge_batches

#: Sets, and shingles, that a tile holds on average at most.
TILE, TILE_SHINGLES = 512, 1 << 21
PIVOTS = 4
#: Keys that a task gathers before it sends them.
PACK = 2_000_000
LEAF, FAN = 16, 4
SALTS = 32
#: From this many parts on, empty parts need no further keys.
ENOUGH_PARTS = 28
#: Finer keys: each is over CELLS cells, of which a part has SPLIT, drawn at
#: random, so differences leave one alone with a chance of (1 - 1/SPLIT) ** CELLS
#: or a little less, and all of them hold one with a chance below 1e-11.
SPLIT, CELLS, FINER = 8, 16, 208
#: Classes of fewer parts have no finer keys: their sets have some 30 shingles.
FEW_PARTS = 8
_M = np.uint64(0x9E3779B97F4A7C15)


# shingle sets
def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word k-grams of consecutive texts."""
    words, bounds = word_hashes(lower_ascii(data), offsets)
    n = len(words)
    out: list[np.ndarray] = []
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled = mix64(rolled * _M + words[i: i + len(rolled)]) if len(rolled) else rolled
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a: b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix64(h * _M + w)
            s = h
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


def _sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, off = utf8(batch.column("text"))
    for a, b in chunks(off):
        for i, s in enumerate(shingle_sets(data[off[a]: off[b]], off[a: b + 1] - off[a], k), a):
            yield i, s


def _unpacked(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Shingle sets of compressed texts."""
    raw = [unsqueeze(t) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return [s for a, b in chunks(off) for s in shingle_sets(np.frombuffer(b"".join(raw[a:b]), np.uint8), off[a: b + 1] - off[a], k)]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# size classes and keys
@lru_cache(maxsize=None)
def size_classes(num: int, den: int) -> tuple[list[int], list[int]]:
    """Lower bounds of the size classes - a set's partner is in its class or a
    neighbouring one - and each class's number of parts."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * den // num + 1)
    parts = []
    for nxt in low[1:]:
        a = nxt - 1
        b = a * den // num
        parts.append((a + b) * (den - num) // (den + num) + 1)
    return low, parts


def classes_of(n: int, num: int, den: int) -> list[int]:
    """The size classes in which a set of n shingles meets others."""
    low, parts = size_classes(num, den)
    own = bisect_right(low, n) - 1
    return [c for c in (own, own - 1) if c >= 0 and parts[c] > 1] if n else []


def nodes_of(digest: bytes, n: int, num: int, den: int) -> list[int]:
    """A set's node in each of its classes: what meets in one class says
    nothing about the other, so blocks don't grow from size to size."""
    base = np.uint64(int.from_bytes(digest[:8], "big"))
    return [int(mix64(np.array([base ^ np.uint64(c + 1)], np.uint64))[0].astype(np.int64)) for c in classes_of(n, num, den)]


def keys_of(s: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The meeting keys of a set in each of its classes (see the module's text)."""
    _, parts = size_classes(num, den)
    n = len(s)
    every = []
    for c in classes_of(n, num, den):
        out = []
        count = np.uint64(parts[c])
        part = ((s >> np.uint64(32)) * count) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(mix64(s ^ _M), start)
        out.append(mix64(sums + mix64(part[start] * np.uint64(2) + np.uint64(c << 40))))
        if parts[c] < ENOUGH_PARTS and len(start) < parts[c]:
            empty = np.setdiff1d(np.arange(parts[c], dtype=np.uint64), part[start])
            prefix = s[: n - (num * n + den - 1) // den + 1]
            tag = mix64(empty * np.uint64(2) + np.uint64((c << 40) + 1))
            out.append(mix64(prefix[None, :] * _M + tag[:, None]).ravel())
        every.append(np.concatenate(out))
    return every


@lru_cache(maxsize=64)
def _cells(c: int, parts: int) -> np.ndarray:
    """The cells of each finer key of a class, the same for all its sets."""
    rng = np.random.default_rng(c)
    return np.stack([rng.choice(SPLIT * parts, CELLS, replace=False) for _ in range(FINER)])


def finer_keys(s: np.ndarray, c: int, num: int, den: int) -> np.ndarray:
    """Keys by which a set meets its partners of size class c (of ``FEW_PARTS``
    parts or more): hashes of what it holds in some cells, none where it holds
    nothing there."""
    parts = size_classes(num, den)[1][c]
    cell = (((s >> np.uint64(32)) * np.uint64(SPLIT * parts)) >> np.uint64(32)).astype(np.int64)
    sums, held = np.zeros(SPLIT * parts, np.uint64), np.zeros(SPLIT * parts, bool)
    np.add.at(sums, cell, mix64(s ^ _M))
    held[cell] = True
    at = _cells(c, parts)
    tag = mix64(np.arange(FINER, dtype=np.uint64) * np.uint64(2) + np.uint64((c << 40) + (1 << 39)))
    return mix64(sums[at].sum(1) + tag)[held[at].any(1)]


# signature tree
class SignatureTree:
    """Sets of a tile, packed in the order of size and smallest token."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
        self.order = np.array(order)
        words = bits // 64
        self.maps = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(sets):
            bit = s & np.uint64(bits - 1)
            np.bitwise_or.at(self.maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.excess = self.size - np.bitwise_count(self.maps).sum(1)
        # levels of nodes: (first, last) in the order, OR map, size range, excess
        self.nodes: list[tuple] = []
        level = [self._leaf(order[a: a + LEAF], a) for a in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._inner(level[a: a + FAN]) for a in range(0, len(level), FAN)]
        self.root = level[0]

    def _leaf(self, members: list[int], first: int) -> int:
        m = np.array(members)
        self.nodes.append((first, first + len(m), np.bitwise_or.reduce(self.maps[m], 0), self.size[m].min(), self.size[m].max(), self.excess[m].max(), ()))
        return len(self.nodes) - 1

    def _inner(self, below: list[int]) -> int:
        if len(below) == 1:
            return below[0]
        parts = [self.nodes[b] for b in below]
        self.nodes.append((parts[0][0], parts[-1][1], np.bitwise_or.reduce([p[2] for p in parts], 0), min(p[3] for p in parts), max(p[4] for p in parts),
                           max(p[5] for p in parts), tuple(below)))
        return len(self.nodes) - 1


def bitmap_bits(sets: list[np.ndarray]) -> int:
    """Two bits a token of the median set, in a power of two."""
    middle = sorted(len(s) for s in sets)[len(sets) // 2]
    return 1 << min(16, max(8, int(2 * middle).bit_length()))


def tree_join(left: SignatureTree, right: SignatureTree, num: int, den: int, apart, link) -> None:
    """Dual traversal. ``apart(i, j)`` tells if two members still need a
    decision (left's i, right's j), ``link(i, j)`` gets each pair that reaches
    num/den; the same tree may be given twice."""
    same = left is right
    todo = [(left.root, right.root)]
    while todo:
        a, b = todo.pop()
        A, B = left.nodes[a], right.nodes[b]
        if A[4] * den < num * B[3] or B[4] * den < num * A[3]:
            continue
        overlap = min(A[4], B[4], int(np.bitwise_count(A[2] & B[2]).sum()) + min(A[5], B[5]))
        if overlap * (num + den) < num * (A[3] + B[3]):
            continue
        mine, other = left.order[A[0]: A[1]], right.order[B[0]: B[1]]
        if not apart.any_apart(mine, other):
            continue
        if A[6] or B[6]:
            if same and a == b:
                todo += [(x, y) for i, x in enumerate(A[6]) for y in A[6][i:]]
            elif A[6] and (not B[6] or A[1] - A[0] >= B[1] - B[0]):
                todo += [(x, b) for x in A[6]]
            else:
                todo += [(a, y) for y in B[6]]
            continue
        x, y = left.size[mine][:, None], right.size[other][None, :]
        maps, others = left.maps[mine][:, None, :], right.maps[other][None, :, :]
        gone = np.bitwise_count(maps & ~others).sum(2)
        come = np.bitwise_count(others & ~maps).sum(2)
        most = np.minimum(x - gone, y - come)
        for i, j in zip(*np.nonzero(most * (num + den) >= num * (x + y))):
            p, q = int(mine[i]), int(other[j])
            if (same and p == q) or (same and a == b and i >= j) or not apart.apart(p, q):
                continue
            s, t = left.sets[p], right.sets[q]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            common = int((t[at] == s).sum())
            if common * den >= num * (len(s) + len(t) - common):
                link(p, q)


class _Groups:
    """Which members are in one component already (by the tile's forest)."""

    def __init__(self, left: list, right: list, forest: Forest):
        self.left, self.right, self.forest = left, right, forest

    def apart(self, p: int, q: int) -> bool:
        return self.forest.root(self.left[p]) != self.forest.root(self.right[q])

    def any_apart(self, mine, other) -> bool:
        root = self.forest.root
        first = root(self.left[mine[0]])
        return any(root(self.left[i]) != first for i in mine) or any(root(self.right[j]) != first for j in other)


def _join_tile(ids: list, groups: list, sides: list, texts: list[bytes], num: int, den: int, k: int) -> Iterator[tuple[int, int]]:
    """Spanning links of a tile (side 0 only) or a pair of tiles (0 with 1)."""
    sets, forest, links = _unpacked(texts, k), Forest(), []
    for i, g in zip(ids, groups):
        forest.join(("g", g), ("i", i))
    names = [("i", i) for i in ids]
    two = 1 in sides
    pick = [[n for n, s in enumerate(sides) if s == side] for side in (0, 1)] if two else [list(range(len(ids)))] * 2
    if not pick[0] or not pick[1]:
        return
    bits = bitmap_bits(sets)
    trees = [SignatureTree([sets[n] for n in p], bits) for p in (pick if two else pick[:1])]
    lists = [[names[n] for n in p] for p in pick]

    def link(p: int, q: int) -> None:
        if forest.join(lists[0][p], lists[1][q]):
            links.append((lists[0][p][1], lists[1][q][1]))

    tree_join(trees[0], trees[-1], num, den, _Groups(*lists, forest), link)
    yield from links


class _Counted:
    """Pairs that count in a tile: one of the two is of the block's size class."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right

    def apart(self, p: int, q: int) -> bool:
        return bool(self.left[p] or self.right[q])

    def any_apart(self, mine, other) -> bool:
        return bool(self.left[mine].any() or self.right[other].any())


def _count_tile(rows: list[tuple], num: int, den: int, k: int) -> Iterator[tuple]:
    """Of a tile's (doc_id, digest, weight, native, side, text): its spanning
    links (u, v, None, None) and each class's links (None, None, digest, n)."""
    rows = list({(r[4], r[1]): r for r in rows}.values())  # a class once, whatever ids repeat
    two = any(r[4] for r in rows)
    sides = [[r for r in rows if r[4] == side] for side in ((0, 1) if two else (0, 0))]
    if not sides[0] or not sides[1]:
        return
    sets = [_unpacked([r[5] for r in side], k) for side in sides[:1 + two]]
    bits = bitmap_bits([s for side in sets for s in side])
    trees = [SignatureTree(side, bits) for side in sets]
    weight = [[r[2] for r in side] for side in sides]
    count = [[0] * len(side) for side in sides]
    if not two:
        count[1] = count[0]
    forest, links = Forest(), []

    def link(p: int, q: int) -> None:
        count[0][p] += weight[1][q]
        count[1][q] += weight[0][p]
        if forest.join((0, p), (int(two), q)):
            links.append((sides[0][p][0], sides[1][q][0], None, None))

    tree_join(trees[0], trees[-1], num, den, _Counted(*(np.array([r[3] for r in side]) for side in sides)), link)
    yield from links
    for side, counted in list(zip(sides, count))[:1 + two]:
        yield from ((None, None, r[1], c) for r, c in zip(side, counted) if c)


def _count_tiles(num: int, den: int, k: int):
    """mapInArrow function over rows sorted by tile."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("tile", "doc_id", "digest", "weight", "native", "side", "text")]
            for tile, *row in zip(*cols):
                if tile != now:
                    yield from _count_tile(held, num, den, k)
                    now, held = tile, []
                held.append(tuple(row))
        yield from _count_tile(held, num, den, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counted(batches)
        while part := list(islice(found, 65536)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["u", "v", "digest", "links"])

    return run


def _join_tiles(num: int, den: int, k: int):
    """mapInArrow function over rows sorted by tile: tile, side, id, grp, text."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        now, held = None, ([], [], [], [])
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("tile", "doc_id", "grp", "side", "text")]
            for tile, *row in zip(*cols):
                if tile != now:
                    if len(held[0]) > 1:
                        yield from _join_tile(*held, num, den, k)
                    now, held = tile, ([], [], [], [])
                for part, v in zip(held, row):
                    part.append(v)
        if len(held[0]) > 1:
            yield from _join_tile(*held, num, den, k)

    return lambda batches: edge_batches(pairs(batches))


# Spark stages
def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, digest and nodes of every row, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, nodes = [], [], []
            for _, s in _sets_of(batch, k):
                n.append(len(s))
                digests.append(_digest(s))
                nodes.append(nodes_of(digests[-1], len(s), num, den))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                                  ["doc_id", "n", "digest", "nodes"])

    return cut_lineage(docs.mapInArrow(run, "doc_id long, n long, digest binary, nodes array<long>"))


def _least_of_each(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least node, and distinct edges (u, v) from the
    other nodes of a key to that one."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    least = np.repeat(node[start], np.diff(np.append(start, len(key))))
    other = node != least
    pair = np.unique(np.column_stack((node[other], least[other])), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return key[start], node[start], np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])


def _meetings(docs: DataFrame, k: int, num: int, den: int, finer: bool = False) -> DataFrame:
    """Edges (u, v) between nodes that share a key; ``finer``: in classes of more
    than ``FINER`` parts a finer key, as these are fewer there."""
    def keys(s: np.ndarray) -> list[np.ndarray]:
        if not finer:
            return keys_of(s, num, den)
        parts, few = size_classes(num, den)[1], None
        out = []
        for i, c in enumerate(classes_of(len(s), num, den)):
            if parts[c] > FINER:
                out.append(finer_keys(s, c, num, den))
            else:
                few = few or keys_of(s, num, den)
                out.append(few[i])
        return out

    def each(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        seen = set()
        for _, s in _sets_of(batch, k):
            if not len(s):
                continue
            digest = _digest(s)
            if digest in seen:  # a copy in the same batch has the same keys
                continue
            seen.add(digest)
            yield nodes_of(digest, len(s), num, den), keys(s)

    return _met(docs, each)


def _finer_meetings(sets: DataFrame, wide: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (u, v) between the ``wide`` nodes (doc_id, native) that share a finer key."""
    def each(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        asked = list(zip(batch.column("own").to_pylist(), batch.column("below").to_pylist()))
        for at in range(0, batch.num_rows, 256):
            for want, s in zip(asked[at:], _unpacked(batch.column("text").slice(at, 256).to_pylist(), k)):
                each = zip(want, nodes_of(_digest(s), len(s), num, den), classes_of(len(s), num, den))
                found = [(node, finer_keys(s, c, num, den)) for w, node, c in each if w and size_classes(num, den)[1][c] >= FEW_PARTS]
                if found:
                    yield [node for node, _ in found], [keys for _, keys in found]

    asked = wide.groupBy("doc_id").agg(F.bool_or("native").alias("own"), F.bool_or(~F.col("native")).alias("below"))
    return _met(sets.join(asked, "doc_id").select("text", "own", "below"), each)


def _met(rows: DataFrame, each) -> DataFrame:
    """Edges (u, v) between nodes that share a key; ``each`` makes a batch's
    nodes and their keys. Nodes of a pack (about ``PACK`` keys of a batch) that
    share a key are joined there: the key travels once, and one spanning edge
    for each node of theirs."""
    buckets = 4 * shuffle_partitions(rows.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, held = [], [], 0
            for its, theirs in each(batch):
                nodes += its
                keys += theirs
                held += sum(map(len, theirs))
                if held > PACK:
                    yield pack(keys, nodes)
                    keys, nodes, held = [], [], 0
            if held:
                yield pack(keys, nodes)

    def pack(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        key = np.concatenate(keys)
        node = np.repeat(np.array(nodes, np.int64), [len(x) for x in keys])
        key, node, u, v = _least_of_each(key, node)
        parts = [("key", key, node), ("edge", u.view(np.uint64), v)]  # edges only pass through a bucket
        columns: dict[str, list] = {"bucket": [], "edges": [], "key": [], "node": []}
        for kind, x, y in parts:
            bucket = (x % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            x, y, bucket = x[order], y[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                columns["bucket"].append(b)
                columns["edges"].append(kind == "edge")
                columns["key"].append(x[cut[b]: cut[b + 1]].tobytes())
                columns["node"].append(y[cut[b]: cut[b + 1]].tobytes())
        types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns.values(), types)], list(columns))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, forest = [], [], Forest()
        for batch in batches:
            for edges, x, y in zip(*(batch.column(c).to_pylist() for c in ("edges", "key", "node"))):
                if edges:
                    for u, v in zip(np.frombuffer(x, np.int64).tolist(), np.frombuffer(y, np.int64).tolist()):
                        forest.join(u, v)
                else:
                    keys.append(np.frombuffer(x, np.uint64))
                    nodes.append(np.frombuffer(y, np.int64))
        if keys:
            _, _, us, vs = _least_of_each(np.concatenate(keys), np.concatenate(nodes))
            del keys, nodes
            for u, v in zip(us.tolist(), vs.tolist()):
                forest.join(u, v)
        yield from edge_batches(forest.stars())

    packed = rows.mapInArrow(emit, "bucket int, edges boolean, key binary, node binary")
    return packed.repartition(shuffle_partitions(rows.sparkSession), "bucket").mapInArrow(meet, "u long, v long")


def _shipped(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The members' texts, compressed, and the digests of their sets: less than
    half the bytes of the sets, which each tile makes again."""
    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            view = memoryview(data)
            yield pa.record_batch([batch.column("doc_id"), pa.array([squeeze(view[off[i]: off[i + 1]]) for i in range(batch.num_rows)], pa.binary())], ["doc_id", "text"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(s) for at in range(0, batch.num_rows, 256) for s in _unpacked(batch.column("text").slice(at, 256).to_pylist(), k)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(digests, pa.binary()), batch.column("text")], ["doc_id", "digest", "text"])

    wanted = members.select("doc_id").distinct()
    packed = docs.mapInArrow(squeezed, "doc_id long, text binary")
    return packed.join(wanted, "doc_id", "left_semi").mapInArrow(marked, "doc_id long, digest binary, text binary")


def _tile_links(sets: DataFrame, members: DataFrame, num: int, den: int, k: int) -> DataFrame:
    rows = sets.select("doc_id", "text").join(members, "doc_id").select("tile", "side", "doc_id", "grp", "text")
    rows = rows.repartition(shuffle_partitions(sets.sparkSession), "tile").sortWithinPartitions("tile")
    return cut_lineage(rows.mapInArrow(_join_tiles(num, den, k), "u long, v long"))


def _all_links(sets: DataFrame, placed: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Spanning links (u, v) and links by class (digest, links): every pair of a
    block's sets is looked at in one tile or pair of tiles."""
    other = placed.select("doc_id", "digest", "weight", "native", "block", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    members = other.select("doc_id", "digest", "weight", "native", F.concat_ws(".", "block", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
                           (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = sets.join(members, ["doc_id", "digest"]).select("tile", "doc_id", "digest", "weight", "native", "side", "text")
    rows = rows.repartition(shuffle_partitions(sets.sparkSession), "tile").sortWithinPartitions("tile")
    return cut_lineage(rows.mapInArrow(_count_tiles(num, den, k), "u long, v long, digest binary, links long"))


def _spanning_links(sets: DataFrame, placed: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Links (u, v) that connect what all links connect."""
    at = F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own")))
    first = placed.select("doc_id", "block", at.alias("t")).select("doc_id", F.concat_ws(".", "block", "t").alias("tile"), F.lit(0).alias("side"), F.col("doc_id").alias("grp"))
    links = _tile_links(sets, first, num, den, k)
    wide = placed.where("tiles > 1").select("doc_id", "block", "own")
    if wide.limit(1).count():
        found = components(links)
        wide = cut_lineage(wide.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                           .select("doc_id", "block", "own", F.coalesce("component", "doc_id").alias("grp")))
        spans = wide.groupBy("block", "own").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        a, b = spans.select("block", *[F.col(c).alias(f"a_{c}") for c in ("own", "lo", "hi")]), spans.select("block", *[F.col(c).alias(f"b_{c}") for c in ("own", "lo", "hi")])
        open_ = a.join(b, "block").where("a_own < b_own and not (a_lo = a_hi and b_lo = b_hi and a_lo = b_lo)")
        open_ = open_.select("block", F.concat_ws(".", "block", "a_own", "b_own").alias("tile"), F.explode(F.array(*[F.struct(F.col(f"{x}_own").alias("own"), F.lit(i).alias("side")) for i, x in enumerate("ab")])).alias("e"))
        second = wide.join(open_.select("block", "tile", "e.*"), ["block", "own"]).select("doc_id", "tile", "side", "grp")
        links = links.unionByName(_tile_links(sets, second, num, den, k))
    return links


def _placed(members: DataFrame) -> DataFrame:
    """``members`` of blocks of two sets or more, with the block's tiles, their
    own one and whether they are among its pivots."""
    members = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    part = members.groupBy("block", "salt").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total"))
    size = part.select("block", "salt").join(part.groupBy("block").agg(F.sum("count").alias("count"), F.sum("total").alias("total")), "block")
    tiles = F.ceil(F.greatest(F.col("count") / TILE, F.col("total") / TILE_SHINGLES)).cast("int")
    spread = F.xxhash64("doc_id", F.lit(1))
    return cut_lineage(members.join(size, ["block", "salt"]).where("count > 1").withColumn("tiles", tiles)
                       .withColumn("own", F.pmod(spread, F.col("tiles")).cast("int"))
                       .withColumn("pivot", (F.col("tiles") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.col("count") / PIVOTS)) == 0)))


def _split_wide(sets: DataFrame, placed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``placed`` with the blocks of more than one tile cut into those whose sets
    meet by finer keys; sets that meet none by them have no partner."""
    low, parts = size_classes(num, den)
    first = next(c for c, p in enumerate(parts) if p >= FEW_PARTS)
    is_wide = (F.col("tiles") > 1) & (F.col("n") >= F.when(F.col("native"), low[first]).otherwise(low[first + 1]))
    wide = placed.where(is_wide)
    if not wide.limit(1).count():
        return placed
    finer = components(_finer_meetings(sets, wide.select("doc_id", "native"), k, num, den))
    columns = ["doc_id", "digest", "n", "weight", "native", "node"]
    again = wide.select(*columns).join(finer, "node").withColumnRenamed("component", "block").select(*columns, "block")
    return _placed(cut_lineage(placed.where(~is_wide).select(*columns, "block").unionByName(again)))


def near_groups(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row: the smallest id
    that is reachable by links of Jaccard similarity num/den or more over the
    distinct word ``k``-grams, and the number of other rows it has a link with."""
    return _groups(keyed(docs, id_col, text_col), k, num, den, True)


def _groups(docs: DataFrame, k: int, num: int, den: int, counted: bool) -> DataFrame:
    """near_groups of (doc_id, text) rows; without counting, n_links is null."""
    with_id = docs.where("doc_id is not null")
    rows = _classes(docs, k, num, den)
    salted = rows.where("doc_id is not null and n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = salted.groupBy("digest", "salt").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("nodes").alias("nodes"), F.count(F.lit(1)).alias("weight"))
    reps = cut_lineage(parts.groupBy("digest").agg(F.min("rep").alias("rep"), F.first("n").alias("n"), F.first("nodes").alias("nodes"), F.sum("weight").alias("weight")))
    blocks = components(_meetings(with_id, k, num, den, not counted))
    members = cut_lineage(reps.select("rep", "digest", "n", "weight", F.posexplode("nodes").alias("place", "node")).join(blocks, "node")
                          .select(F.col("rep").alias("doc_id"), "digest", "n", "weight", (F.col("place") == 0).alias("native"), "node", F.col("component").alias("block")))
    placed = _placed(members)
    sets = cut_lineage(_shipped(with_id, placed.select("doc_id"), k))  # read by the finer meetings and both rounds of tiles
    if not counted:
        placed = _split_wide(sets, placed, k, num, den)
    links = (_all_links if counted else _spanning_links)(sets, placed, num, den, k)
    groups = components(links.where("u is not null").select("u", "v")).withColumnsRenamed({"node": "rep", "component": "component_id"})
    by_class = reps.join(groups, "rep", "left").select("digest", "weight", F.coalesce("component_id", "rep").alias("component_id"))
    if counted:
        others = links.where("digest is not null").groupBy("digest").agg(F.sum("links").alias("links"))
        by_class = by_class.join(others, "digest", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    else:
        by_class = by_class.withColumn("n_links", F.lit(None).cast("long"))
    by_class = by_class.select("digest", "component_id", "n_links")
    named = salted.select("doc_id", "n", "digest", "salt").join(parts.select("digest", "salt").join(by_class, "digest"), ["digest", "salt"])
    # rows that share an id are one node: the smallest component of any
    rest = rows.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0 if counted else None).cast("long").alias("n_links"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(rest)


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (rows
    without an id or without words all stay)."""
    groups = _groups(keyed(docs), k, num, den, False)
    gone = groups.where("component_id is not null and component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
