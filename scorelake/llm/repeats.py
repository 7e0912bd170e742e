"""Removal of repeated passages with longest-previous-factor arrays (op 2).

A byte goes if some string of ``SPAN`` bytes over it also starts in a document
with a smaller id. Texts are their UTF-8 bytes, matches stay inside documents,
overlaps count, and everything is judged on the input.

The suffix array is split by content. A window of SPAN bytes is filed under
its minimizer, the ``GRAM``-byte gram of least hash: equal windows have equal
minimizers at equal places, so everything that can match is filed together,
and a window stands with others only if its minimizer occurs in two documents.

A. Each task lists its texts' minimizers (about one per 14 bytes), packed by
   hash bucket. B. A bucket finds those of two or more documents and reports
   them to the documents. C. A document marks the windows filed under them.
   Windows that repeat an earlier document of the same task are settled there;
   contexts of the others go to the bucket of their minimizer - or, if it
   occurs in more than ``HOT`` documents, one by one to the bucket of their own
   hash, which splits any hot group. D. A bucket sorts its suffixes (by SPAN
   bytes) and takes previous and next smaller positions, with documents as
   positions, to get longest previous factors; those of SPAN bytes go. E. A
   document gets its windows back and drops the bytes they cover; what it keeps
   and the spans it lost leave the stage as its row, without another exchange.

Equal texts are one: only the smallest id takes part, and later copies of
SPAN bytes or more lose every byte. All exchanges carry compressed blocks of
arrays, and every stage holds a slice of a bucket at a time.

Cases: null texts count as empty; texts under SPAN bytes keep everything;
texts of any length are handled in overlapping pieces; rows with one id are
never each other's earlier document; null ids come after all others; an empty
table gives an empty result; other columns are not read. A span may begin or end
inside a character, so kept texts are bytes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import cut_lineage, keyed, mix64, shuffle_partitions, utf8

SPAN, GRAM = 50, 24
REACH = SPAN - GRAM + 1
#: A minimizer in more documents than this is filed window by window.
HOT = 4096
#: Bytes of text handled at once, and windows sorted at once.
PIECE, WINDOWS = 2 << 20, 1 << 18
SALTS = 32
LAST = (1 << 63) - 1
_WORDS = (SPAN + 7) // 8
#: Kinds of blocks; a task gets them in this order.
_IDS, _SHARED, _RUNS, _TEXTS, _CONTEXTS = range(5)
BLOCKS = "label int, kind int, payload binary"


# packed blocks
def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each behind its type and length, compressed."""
    out = bytearray()
    for a in arrays:
        out += a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + a.tobytes()
    return zstandard.compress(bytes(out), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(raw), 0, []
    while at < len(data):
        kind = np.dtype(data[at: at + 4].decode().strip())
        n = int.from_bytes(data[at + 4: at + 12], "little")
        out.append(np.frombuffer(data, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def _gaps(ids: np.ndarray) -> np.ndarray:
    """Ids as differences, which compress well; undone by cumsum."""
    with np.errstate(over="ignore"):
        return np.diff(ids, prepend=ids.dtype.type(0))


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    label, kind, payload = zip(*rows)
    return pa.record_batch([pa.array(label, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["label", "kind", "payload"])


def bucket_labels(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n buckets a number that Spark's hash partitioning into n
    puts into a partition of its own."""
    found = spark.range(40 * n).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(n)).alias("p"))
    rows = found.groupBy("p").agg(F.min("label").alias("label")).collect()  # n rows
    out = np.full(n, -1, np.int32)
    for r in rows:
        out[r.p] = r.label
    out[out < 0] = rows[0].label
    return out


def _by_label(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in the given order) for all non-empty buckets."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), order[cut[b]: cut[b + 1]]


# minimizers
def _loads(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian 8-byte words at every offset (zeros after the end)."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[: len(x) - step] |= x[step:] << np.uint64(8 * step)
    return x[: len(data)]


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer, of the texts data[start:end]:
    first and last window start, the minimizer's hash, the text's index."""
    n = len(data)
    if n < SPAN:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    x = _loads(data)
    grams = n - GRAM + 1
    h = x[:grams] * np.uint64(0x9E3779B97F4A7C15) + x[8: 8 + grams] * np.uint64(0xD6E8FEB86659FD93) + x[16: 16 + grams] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 24) - 1)  # a piece has under 2**24 bytes
    m = (h & ~low) | np.arange(grams, dtype=np.uint64)
    reach = 1
    while reach * 2 <= REACH:
        m = np.minimum(m[: len(m) - reach], m[reach:])
        reach *= 2
    m = np.minimum(m[: len(m) - (REACH - reach)], m[REACH - reach:])
    place = (m & low).astype(np.int64)  # of window s = 0 ...
    size = np.maximum(ends - starts - SPAN + 1, 0)
    owner = np.repeat(np.arange(len(starts)), size)
    s = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    at = place[s]
    if not len(s):
        return s, s, np.zeros(0, np.uint64), owner
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return s[first], s[last], mix64(h[at[first]]), owner[first]


class _Piece:
    """Texts, or a part of a long one, that are handled together."""

    def __init__(self):
        self.parts, self.starts, self.ends, self.size = [], [], [], 0
        self.ids, self.tags, self.shift = [], [], []

    def add(self, raw: bytes, doc_id: int, tag: int, shift: int) -> None:
        self.starts.append(self.size)
        self.parts.append(raw)
        self.size += len(raw)
        self.ends.append(self.size)
        self.ids.append(doc_id)
        self.tags.append(tag)
        self.shift.append(shift)

    def arrays(self):
        return (np.frombuffer(b"".join(self.parts), np.uint8), np.array(self.starts, np.int64), np.array(self.ends, np.int64),
                np.array(self.ids, np.int64), np.array(self.tags, np.uint32), np.array(self.shift, np.int64))


def _pieces(texts: Iterator[tuple[int, int, bytes]]) -> Iterator[_Piece]:
    """Pieces of about PIECE bytes; a longer text's parts overlap by SPAN - 1
    bytes, so that every window is in one part."""
    piece = _Piece()
    for doc_id, tag, raw in texts:
        for a in range(0, max(1, len(raw) - SPAN + 1), PIECE):
            part = raw[a: a + PIECE + SPAN - 1]
            if len(part) < SPAN:
                continue
            if piece.size and piece.size + len(part) > PIECE:
                yield piece
                piece = _Piece()
            piece.add(part, doc_id, tag, a)
    if piece.size:
        yield piece


def _distinct_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(smallest id, tag, bytes) of a batch's different texts, by id."""
    data, off = utf8(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    view, least = memoryview(data), {}
    for i in range(len(ids)):
        digest = _digest(view[off[i]: off[i + 1]])
        k = LAST if ids[i] is None else ids[i]
        if digest not in least or k < least[digest][0]:
            least[digest] = (k, i)
    for digest, (k, i) in sorted(least.items(), key=lambda e: (e[1][0], e[0])):
        yield k, _tag(digest), bytes(view[off[i]: off[i + 1]])


def _digest(raw) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _tag(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "little")


# A: minimizers by bucket
def _list_minimizers(labels: np.ndarray):
    n = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for piece in _pieces(_distinct_texts(batch)):
                data, starts, ends, doc, _, _ = piece.arrays()
                _, _, key, owner = windows_of(data, starts, ends)
                keys.append(key)
                ids.append(doc[owner])
            if keys:
                key, doc = np.concatenate(keys), np.concatenate(ids)
                rows = []
                for b, at in _by_label((key % np.uint64(n)).astype(np.int64), n):
                    print_ = key[at] >> np.uint64(24)  # 40 bits, besides the bucket
                    rows.append((int(labels[b]), _SHARED, _pack(print_.astype(np.uint32), (print_ >> np.uint64(32)).astype(np.uint8), _gaps(doc[at]))))
                if rows:
                    yield _blocks(rows)

    return run


def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


# B: minimizers of two documents or more, reported to the documents
def _find_shared(labels: np.ndarray):
    n = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, tops, ids = [], [], []
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                low, top, doc = _unpack(raw)
                lows.append(low)
                tops.append(top)
                ids.append(np.cumsum(doc))
        if not lows:
            return
        key = np.concatenate(lows).astype(np.uint64) | np.concatenate(tops).astype(np.uint64) << np.uint64(32)
        doc = np.concatenate(ids)
        del lows, tops, ids
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[fresh], doc[fresh]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
        key, doc, hot = key[count > 1], doc[count > 1], (count[count > 1] > HOT).astype(np.uint8)
        order = np.argsort(doc, kind="stable")
        key, doc, hot = key[order], doc[order], hot[order]
        for b, at in _by_label(_doc_bucket(doc, n), n):
            yield _blocks([(int(labels[b]), _SHARED, _pack(key[at].astype(np.uint32), (key[at] >> np.uint64(32)).astype(np.uint8), _gaps(doc[at]), hot[at]))])

    return run


# texts and first ids, by document
def _ship_texts(labels: np.ndarray):
    n = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to: dict[int, list] = defaultdict(list)
            for k, _, raw in _distinct_texts(batch):
                to[int(_doc_bucket(np.array([k]), n)[0])].append((k, raw))
            for b, texts in to.items():
                size = np.array([len(t) for _, t in texts], np.int64)
                body = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
                yield _blocks([(int(labels[b]), _TEXTS, _pack(np.array([k for k, _ in texts], np.int64), size, body))])

    return run


def _ship_ids(labels: np.ndarray):
    """The first id and the digest of every text that takes part, and how many
    of its rows have that id, or none."""
    n = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("first_id").to_numpy(zero_copy_only=False).astype(np.int64)
            tags = np.array([_tag(d) for d in batch.column("digest").to_pylist()], np.uint32)
            count = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) if c in batch.schema.names else np.full(len(ids), one, np.int64)
                     for c, one in (("n_ids", 1), ("n_nulls", 0))]
            rows = []
            for b, at in _by_label(_doc_bucket(ids, n), n):
                at = at[np.argsort(ids[at], kind="stable")]
                rows.append((int(labels[b]), _IDS, _pack(_gaps(ids[at]), tags[at], *(c[at] for c in count))))
            if rows:
                yield _blocks(rows)

    return run


class _Part:
    """What a document bucket gets, in the order of its kinds."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches
        self.ids: dict[tuple[int, int], tuple[int, int]] = {}
        self.other: dict[int, list[list[np.ndarray]]] = defaultdict(list)

    def texts(self) -> Iterator[tuple[int, int, bytes]]:
        """(id, tag, bytes), each text once; the other kinds are read before."""
        done = set()
        for batch in self.batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist()):
                arrays = _unpack(raw)
                if kind == _IDS:
                    self.ids.update(zip(zip(np.cumsum(arrays[0]).tolist(), arrays[1].tolist()), zip(arrays[2].tolist(), arrays[3].tolist())))
                elif kind != _TEXTS:
                    self.other[kind].append(arrays)
                else:
                    self.ready()
                    at, body = 0, arrays[2].tobytes()
                    for k, size in zip(arrays[0].tolist(), arrays[1].tolist()):
                        text = body[at: at + size]
                        at += size
                        tag = _tag(_digest(text))
                        if (k, tag) in self.ids and (k, tag) not in done:
                            done.add((k, tag))
                            yield k, tag, text

    def ready(self) -> None:
        """Called before the first text, and before each block of them."""


# C: contexts of shared minimizers
class _Marks(_Part):
    """Which (document, minimizer) pairs are shared, and which are hot."""

    found: np.ndarray | None = None

    @staticmethod
    def join(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        return mix64(doc.astype(np.uint64)) ^ (key * np.uint64(0xD6E8FEB86659FD93))

    def ready(self) -> None:
        if self.found is None:
            parts = self.other.pop(_SHARED, [])
            both = np.concatenate([self.join(np.cumsum(d), lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32)) for lo, hi, d, _ in parts]) if parts else np.zeros(0, np.uint64)
            hot = np.concatenate([x[3] for x in parts]) if parts else np.zeros(0, np.uint8)
            order = np.argsort(both)
            self.found, self.hot = both[order], hot[order]

    def look(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Is it shared, is it hot."""
        if not len(self.found):
            return np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        q = self.join(doc, key >> np.uint64(24))
        at = np.minimum(np.searchsorted(self.found, q), len(self.found) - 1)
        hit = self.found[at] == q
        return hit, hit & (self.hot[at] > 0)


def _window_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SPAN bytes at each offset as big-endian words, one row a word."""
    pad = np.concatenate((data, np.zeros(8 * _WORDS, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(pad, 8 * _WORDS)[at]
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    words[:, -1] &= ~np.uint64((1 << (8 * (8 * _WORDS - SPAN))) - 1)
    return words.T


def longest_previous_factors(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes, given by their first SPAN bytes and their documents: the
    longest prefix shared with a suffix of a smaller document. Factors under
    SPAN are only bounded (in whole words), as nothing depends on them.

    The previous smaller position of a suffix, in suffix order, is found by
    jumping along its neighbour's answer while documents are not smaller, with
    the common prefix as the minimum over the jumps; the next smaller one
    likewise, where the previous didn't already give a full factor.
    """
    n = len(doc)
    order = np.lexsort(words[::-1])
    w, d = words[:, order], doc[order]
    common = np.zeros(n + 1, np.int64)  # of suffixes i - 1 and i
    same = np.ones(max(0, n - 1), bool)
    for k in range(len(w)):
        same &= w[k, 1:] == w[k, :-1]
        common[1:n][same] = min(SPAN, 8 * (k + 1))

    def smaller(step: int, shared: np.ndarray, busy: np.ndarray) -> np.ndarray:
        at = np.arange(n) + step
        while len(busy):
            busy = busy[d[at[busy]] >= d[busy]]
            jump = at[busy]
            shared[busy] = np.minimum(shared[busy], shared[jump])
            at[busy] = at[jump]
            busy = busy[shared[busy] >= SPAN]
        return shared

    before = smaller(-1, common[:n].copy(), np.flatnonzero(common[:n] >= SPAN))
    after = smaller(1, common[1:].copy(), np.flatnonzero((common[1:] >= SPAN) & (before < SPAN)))
    lpf = np.empty(n, np.int64)
    lpf[order] = np.maximum(before, np.where(before < SPAN, after, 0))
    return lpf


def _repeated(data: np.ndarray, at: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which windows data[at: at + SPAN] have a full factor; windows of one key
    meet, a slice of keys at a time."""
    gone = np.zeros(len(at), bool)
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(k))
    mixed = d[start] != d[end - 1] if len(k) else new
    size = (end - start)[mixed]
    rows = order[np.repeat(mixed, end - start)]
    bound = np.concatenate(([0], np.cumsum(size)))
    a = 0
    while a < len(rows):
        b = max(int(bound[np.searchsorted(bound, a + WINDOWS, side="right") - 1]), int(bound[np.searchsorted(bound, a, side="right")]))
        part = rows[a:b]
        gone[part] = longest_previous_factors(_window_words(data, at[part]), doc[part]) >= SPAN
        a = b
    return gone


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], first[i] + 1, ... (count[i] of them) for all i, and each one's i."""
    which = np.repeat(np.arange(len(first)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count), which


def _runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows as (doc, tag, first, length) runs."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(doc)) - 1] if len(doc) else start
    return doc[at], tag[at], start[at], (last - start[at] + 1).astype(np.int32)


def _run_rows(labels: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> list[tuple[int, int, bytes]]:
    doc, tag, start, length = _runs(doc, tag, start)
    return [(int(labels[b]), _RUNS, _pack(_gaps(doc[at]), tag[at], start[at], length[at])) for b, at in _by_label(_doc_bucket(doc, len(labels)), len(labels))]


def _find_contexts(labels: np.ndarray):
    n = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(batches)
        for piece in _pieces(marks.texts()):
            data, starts, ends, ids, tags, shift = piece.arrays()
            s0, s1, key, owner = windows_of(data, starts, ends)
            hit, hot = marks.look(ids[owner], key)
            s0, s1, key, owner, hot = s0[hit], s1[hit], key[hit], owner[hit], hot[hit]
            count = s1 - s0 + 1
            mask = (np.uint32(1) << count.astype(np.uint32)) - np.uint32(1)
            at, r = _spread(s0, count)
            gone = _repeated(data, at, ids[owner[r]], key[r])
            np.subtract.at(mask, r[gone], np.uint32(1) << (at - s0[r])[gone].astype(np.uint32))
            o = owner[r[gone]]
            rows = _run_rows(labels, ids[o], tags[o], at[gone] - starts[o] + shift[o]) if gone.any() else []
            # what is left goes on: whole contexts, or single windows of hot minimizers
            alone = ~gone & hot[r]
            if alone.any():
                w = _window_words(data, at[alone])
                h = np.zeros(w.shape[1], np.uint64)
                for part in w:
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + part)
                one = np.ones(len(h), np.int64)
                rows += _context_rows(labels, data, at[alone], one, one.astype(np.uint32), h, owner[r[alone]], starts, ids, tags, shift)
            whole = (mask > 0) & ~hot
            rows += _context_rows(labels, data, s0[whole], count[whole], mask[whole], key[whole], owner[whole], starts, ids, tags, shift)
            if rows:
                yield _blocks(rows)

    return run


def _context_rows(labels, data, first, count, mask, key, owner, starts, ids, tags, shift) -> list[tuple[int, int, bytes]]:
    out, n = [], len(labels)
    for b, at in _by_label((key % np.uint64(n)).astype(np.int64), n):
        body, _ = _spread(first[at], count[at] + SPAN - 1)
        o = owner[at]
        out.append((int(labels[b]), _CONTEXTS, _pack(key[at], _gaps(ids[o]), tags[o], first[at] - starts[o] + shift[o], count[at].astype(np.uint8), mask[at], data[body])))
    return out


# D: factors
def _find_factors(labels: np.ndarray):
    def decide(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, ids, tags, start, count, mask = (np.concatenate([np.cumsum(x[i]) if i == 1 else x[i] for x in held]) for i in range(6))
        data = np.concatenate([x[6] for x in held])
        count = count.astype(np.int64)
        size = count + SPAN - 1
        first = np.cumsum(size) - size
        # contexts by key, a slice of keys at a time
        order = np.argsort(key, kind="stable")
        k = key[order]
        bound = np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k))
        total = np.concatenate(([0], np.cumsum(count[order])))
        a = 0
        while a < len(k):
            b = max(int(bound[np.searchsorted(bound, np.searchsorted(total, total[a] + 4 * WINDOWS, side="right") - 1, side="right") - 1]), int(bound[np.searchsorted(bound, a, side="right")]))
            part = order[a:b]
            a = b
            at, r = _spread(first[part], count[part])
            off = at - first[part][r]
            wanted = (mask[part][r] >> off.astype(np.uint32)) & np.uint32(1) == 1
            at, r, off = at[wanted], part[r[wanted]], off[wanted]
            gone = _repeated(data, at, ids[r], key[r])
            if gone.any():
                r, off = r[gone], off[gone]
                yield _blocks(_run_rows(labels, ids[r], tags[r], start[r] + off))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for label, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "kind", "payload"))):
                if kind == _CONTEXTS:
                    held.append(_unpack(raw))
                else:
                    yield _blocks([(label, kind, raw)])
        if held:
            yield from decide(held)

    return run


# E: what is left of every text
class _Removed(_Part):
    found: tuple | None = None

    def ready(self) -> None:
        if self.found is None:
            parts = self.other.pop(_RUNS, [])
            cols = [np.concatenate([np.cumsum(x[i]) if i == 0 else x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
            order = np.argsort(cols[0], kind="stable")
            self.found = tuple(c[order] for c in cols)

    def of(self, doc_id: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        ids, tags, start, length = self.found
        a, b = np.searchsorted(ids, [doc_id, doc_id + 1]) if doc_id < LAST else (np.searchsorted(ids, doc_id), len(ids))
        mine = tags[a:b] == tag
        return start[a:b][mine], length[a:b][mine].astype(np.int64)


def _left(part: _Removed) -> Iterator[tuple[int, int, bytes, bytes, np.ndarray]]:
    """(id, tag, text, kept bytes, removed spans as rows of begin and end)."""
    for doc_id, tag, text in part.texts():
        start, length = part.of(doc_id, tag)
        spans, kept = np.zeros((0, 2), np.int64), text
        if len(start):
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length - 1 + SPAN, -1)
            cover = np.zeros(len(text) + 2, np.int8)
            cover[1:-1] = np.cumsum(edge[:-1]) > 0
            spans = np.flatnonzero(np.diff(cover)).reshape(-1, 2)
            kept = np.frombuffer(text, np.uint8)[cover[1:-1] == 0].tobytes()
        yield doc_id, tag, text, kept, spans


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every text's first id."""
    part, rows, held = _Removed(batches), [], 0
    for doc_id, tag, text, kept, spans in _left(part):
        n_ids, n_nulls = part.ids[doc_id, tag]
        for own, count in ((doc_id, n_ids), (None, n_nulls)):
            for _ in range(count):
                rows.append((own, len(text), kept, spans))
                held += len(kept) + 1024
                if held > PIECE:
                    yield _kept_rows(rows)
                    rows, held = [], 0
    if rows:
        yield _kept_rows(rows)


def _kept_rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, size, kept, spans = zip(*rows)
    begin, end = np.concatenate(spans).T
    offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"])
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), each)],
                           ["doc_id", "n_bytes", "kept", "spans"])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what stage E keeps, a row for every text."""
    for _, _, text, kept, spans in _left(_Removed(batches)):
        yield pa.record_batch([[_digest(text)], [len(text) - len(kept)], [len(spans)], [hashlib.sha256(kept).hexdigest()]], ["digest", "first_removed", "first_spans", "first_sha"])


def _text_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, sizes and digests, and the texts under SPAN bytes themselves."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        view = memoryview(data)
        texts = [view[off[i]: off[i + 1]] for i in range(batch.num_rows)]
        short = pa.array([bytes(t) if len(t) < SPAN else None for t in texts], pa.binary())
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(map(_digest, texts), pa.binary()), short], ["doc_id", "n_bytes", "digest", "short"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), spans (begin and end of each
    removed stretch in the text's bytes) of every row."""
    docs = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    labels = bucket_labels(spark, n)
    salted = cut_lineage(docs.mapInArrow(_text_digests, "doc_id long, n_bytes long, digest binary, short binary")
                         .withColumn("place", F.coalesce("doc_id", F.lit(LAST))).withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS))))
    long = salted.where(F.col("n_bytes") >= SPAN)
    # a place has one salt, so its rows are counted there
    places = long.groupBy("digest", "salt", "place").agg(F.count("doc_id").alias("n_ids"), F.count_if(F.col("doc_id").isNull()).alias("n_nulls"))
    parts = places.groupBy("digest", "salt").agg(F.min(F.struct("place", "n_ids", "n_nulls")).alias("first"))
    firsts = parts.groupBy("digest").agg(F.min("first").alias("first")).select("digest", F.col("first.place").alias("first_id"), "first.n_ids", "first.n_nulls")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "label").sortWithinPartitions("kind")

    ids = firsts.mapInArrow(_ship_ids(labels), BLOCKS)
    texts = docs.mapInArrow(_ship_texts(labels), BLOCKS)
    shared = docs.mapInArrow(_list_minimizers(labels), BLOCKS).repartition(n, "label").mapInArrow(_find_shared(labels), BLOCKS)
    contexts = dealt(ids.unionByName(shared).unionByName(texts)).mapInArrow(_find_contexts(labels), BLOCKS)
    factors = contexts.repartition(n, "label").mapInArrow(_find_factors(labels), BLOCKS)
    spans = "array<struct<begin: long, end: long>>"
    first = dealt(ids.unionByName(factors).unionByName(texts)).mapInArrow(_keep, f"doc_id long, n_bytes long, kept binary, spans {spans}")
    copies = long.join(parts.select("digest", "salt").join(firsts.select("digest", "first_id"), "digest"), ["digest", "salt"]).where("place > first_id")
    copies = copies.select("doc_id", "n_bytes", F.lit(b"").alias("kept"), F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end"))).alias("spans"))
    short = salted.where(F.col("n_bytes") < SPAN).select("doc_id", "n_bytes", F.col("short").alias("kept"), F.array().cast(spans).alias("spans"))
    return first.unionByName(copies).unionByName(short)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, from the
    kept texts and spans."""
    return without_repeats(docs, id_col, text_col).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
