"""Language-model scoring by partial matching (op 11).

A context trie over the bytes of lower-cased training texts, ``ORDER`` bytes
deep, holds how often each byte (or the end of the text) followed each context.
A text's probability is the product over its bytes and its end: the longest
known context gives (2 count - 1) / (2 total) of the byte; a byte it hasn't
seen costs an escape, distinct / (2 total), and goes to the context
one byte shorter, whose counts leave out the bytes that the longer one has
(symbol exclusion); what no context has seen shares the last escape evenly.
The code length in bits is -score / log10(2).

Every set of bytes seen in a context is contained in that of its suffix. So the
count that exclusion takes from the suffix is one number per context, and the
probability of a gram (a context of ``ORDER`` bytes and the byte after it)
depends on the counts of its own suffixes only. The job is thus built on grams:

1. texts are read once, in blocks of about ``BLOCK`` bytes; a task writes each
   block's texts, compressed, and its distinct grams with their counts in
   training texts, dealt to ``SHARDS`` shards by the last two bytes of the
   context, whose longer contexts are all in the same shard;
2. a shard's counts are merged into its part of the trie, which grows with the
   corpus and is never in one place; orders 0 and 1 (258 * 258 counts at most)
   and the totals are all that reaches the driver;
3. the blocks' grams meet the shards of the trie and get their code lengths;
4. these come back to the blocks and are added up over the bytes of each text.

Word counts for the unigram base go the same way, dealt by the words' hashes.
With more shuffle partitions than shards, shards are salted by block. Code
lengths are kept in millionths and base terms in billionths (of log10), as whole
numbers, so that sums are the same in any order.

Cases: null texts count as empty, and an empty one is its end alone; a null id
is never held out; repeated rows count and are scored each; an empty table gives
an empty result, and without training texts all bytes are equally likely; long
texts are cut at white space into pieces of about ``PIECE`` bytes that keep
their context (a word is never cut, whatever its length); other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut_lineage, keyed, lower_ascii, mix64, shuffle_partitions, utf8, word_hashes
from scorelake.llm.importance import crc_sql

#: Bytes of a context. 9 bits a symbol: bytes, START before a text, END after it.
ORDER, START, END = 5, 256, 257
SYMBOLS = 257
#: Bytes of a block's texts, of a piece that is worked on at a time, and shards.
BLOCK, PIECE, SHARDS = 32 << 20, 1 << 20, 512
#: Units of a code length and of a base term, a log10 each.
UNIT, BASE_UNIT = 1e6, 1e9
GRAMS, WORDS, TEXTS = 0, 1, 2
#: Keys that are looked up at a time.
STEP = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PARTS = "kind int, block long, shard long, keys binary, vals binary"
_DOC = 64 - 9 * (ORDER + 1)  # bits for a text's place beside a gram


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are not learned from: crc32(doc_id as text) mod 10 = 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


class Group:
    """Lower-cased texts that are worked on together: the place of each among
    the caller's, its bytes, what goes before it and whether its end is in."""

    def __init__(self):
        self.owner, self.texts, self.before, self.last, self.size = [], [], [], [], 0

    def add(self, owner: int, text: np.ndarray, before: np.ndarray, last: bool) -> None:
        self.owner.append(owner)
        self.texts.append(text)
        self.before.append(before)
        self.last.append(last)
        self.size += len(text) + ORDER + 1

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every byte and end: the gram that it closes, and its text's place here."""
        length = np.array([len(t) for t in self.texts], np.int64)
        ends = np.array(self.last, np.int64)
        whole = length + ORDER + 1
        begin = np.concatenate(([0], np.cumsum(whole)))
        symbols = np.full(begin[-1] + ORDER, END, np.int64)
        flat = np.concatenate(self.texts) if self.texts else np.zeros(0, np.uint8)
        inner = np.arange(len(flat)) + np.repeat(begin[:-1] + ORDER - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        symbols[inner] = flat
        symbols[(begin[:-1, None] + np.arange(ORDER)).ravel()] = np.concatenate(self.before)
        gram = symbols[: begin[-1]].copy()
        for k in range(1, ORDER + 1):
            gram = gram << 9 | symbols[k: begin[-1] + k]
        owner = np.repeat(np.arange(len(length)), whole)
        at = np.arange(begin[-1]) - np.repeat(begin[:-1], whole)
        keep = at < np.repeat(length + ends, whole)
        return gram[keep], owner[keep]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and their texts' places here."""
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        hashes, bounds = word_hashes(np.concatenate(self.texts) if self.texts else np.zeros(0, np.uint8), offsets)
        return hashes.view(np.int64), np.repeat(np.arange(len(self.texts)), np.diff(bounds))


_NEW = np.full(ORDER, START, np.int64)


def groups(texts: Iterator[np.ndarray]) -> Iterator[Group]:
    """Groups of about ``PIECE`` bytes of lower-cased texts; a longer text is
    cut at white space."""
    group = Group()
    for i, text in enumerate(texts):
        a, before = 0, _NEW
        while True:
            b = len(text)
            if b - a > PIECE:
                step = a + PIECE
                while step < b:  # the next white space, looked for a piece at a time
                    found = np.flatnonzero(_SPACE[text[step: step + PIECE]])
                    if len(found):
                        step += int(found[0])
                        break
                    step += PIECE
                b = min(step, b)
            group.add(i, text[a:b], before, b == len(text))
            if group.size >= PIECE or len(group.texts) >= 1 << _DOC:
                yield group
                group = Group()
            if b == len(text):
                break
            before = np.concatenate((before, text[max(a, b - ORDER): b].astype(np.int64)))[-ORDER:]
            a = b
    if group.texts:
        yield group


def _distinct(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1 if len(keys) else 0)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


class Counts:
    """Distinct keys with their counts, merged now and then."""

    def __init__(self):
        self.parts, self.new, self.size = [], 0, 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.new += len(keys)
        if self.new > max(self.size, 1 << 18):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            self.parts = [_distinct(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))] if self.parts else [(np.zeros(0, np.int64),) * 2]
        self.new, self.size = 0, len(self.parts[0][0])
        return self.parts[0]


def _shard(kind: int, keys: np.ndarray) -> np.ndarray:
    """Grams go by the last two symbols of their context, words by themselves."""
    if kind == GRAMS:
        keys = keys >> 9 & ((1 << 18) - 1)
    return (mix64(keys.view(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def _packed(n: np.ndarray) -> bytes:
    """Whole numbers in 32 bits each, or in 64 where one needs it."""
    small = not len(n) or -(1 << 31) <= int(n.min()) and int(n.max()) < 1 << 31
    return (n.astype(np.int32) if small else n).tobytes()


def _unpacked(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if len(raw) == 8 * count else np.int32).astype(np.int64)


def _pair(k, v) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of a row's two binary columns."""
    keys = _numbers(k.as_py())
    return keys, _unpacked(v.as_py(), len(keys))


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "keys": pa.binary(), "vals": pa.binary()}
    return pa.record_batch([pa.array(v, types.get(k, pa.int64())) for k, v in columns.items()], list(columns))


def _by_shard(kind: int, block: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A block's keys and numbers as one row per shard."""
    shard = _shard(kind, keys)
    order = np.argsort(shard, kind="stable")
    shard, keys, n = shard[order], keys[order], n[order]
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = [*first[1:], len(shard)]
    return _rows({"kind": [kind] * len(first), "block": [block] * len(first), "shard": shard[first].tolist(),
                  "keys": [keys[a:b].tobytes() for a, b in zip(first, ends)], "vals": [_packed(n[a:b]) for a, b in zip(first, ends)]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a partition, block by block: compressed (rows TEXTS), and the
    distinct grams and words with their counts in training texts."""
    base, number = TaskContext.get().partitionId() << 32, 0
    grams, words, size = Counts(), Counts(), 0

    def done(block: int) -> Iterator[pa.RecordBatch]:
        for kind, counts in ((GRAMS, grams), (WORDS, words)):
            keys, n = counts.merged()
            if len(keys):
                yield _by_shard(kind, block, keys, n)

    for batch in batches:
        data, off = utf8(batch.column("text"))
        ids, held = batch.column("doc_id"), batch.column("held").to_numpy(zero_copy_only=False)
        a = 0
        while a < batch.num_rows:
            b = min(max(int(np.searchsorted(off, off[a] + PIECE, side="right")) - 1, a + 1), a + (1 << _DOC), batch.num_rows)
            low = lower_ascii(data[off[a]: off[b]])
            part = ids.slice(a, b - a)
            vals = np.stack([part.fill_null(0).to_numpy(), part.is_null().to_numpy(zero_copy_only=False), held[a:b], np.diff(off[a: b + 1])]).astype(np.int64)
            yield _rows({"kind": [TEXTS], "block": [base + number], "shard": [0], "keys": [pa.compress(low.tobytes(), "zstd", asbytes=True)], "vals": [vals.tobytes()]})
            for group in groups(low[off[i] - off[a]: off[i + 1] - off[a]] for i in range(a, b)):
                train = ~held[a:b][np.array(group.owner)].astype(bool)
                for counts, (keys, owner) in ((grams, group.grams()), (words, group.words())):
                    if counts is grams:  # one sort: the flag beside the gram
                        both = np.sort(keys << 1 | train[owner])
                        first = np.flatnonzero(np.diff(both >> 1, prepend=-1))
                        counts.add(both[first] >> 1, np.add.reduceat(both & 1, first))
                    elif len(keys):
                        counts.add(*_distinct(keys, train[owner].astype(np.int64)))
            size += int(off[b] - off[a])
            a = b
            if size >= BLOCK:
                yield from done(base + number)
                grams, words, size, number = Counts(), Counts(), 0, number + 1
    yield from done(base + number)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Consecutive rows of equal keys, as slices; a run must be read to its end."""
    held: list[pa.RecordBatch] = []

    def slices() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in keys]
            change = np.zeros(max(batch.num_rows - 1, 0), bool)
            for c in columns:
                change |= np.diff(c) != 0
            cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)

    source = slices()

    def of(key: tuple) -> Iterator[pa.RecordBatch]:
        yield held.pop()[1]
        for k, part in source:
            if k != key:
                held.append((k, part))
                return
            yield part

    for k, part in source:
        held.append((k, part))
        while held:
            key = held[-1][0]
            yield key, of(key)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (kind, shard, block) run added up; keys without a count go."""
    for (kind, shard, block), parts in _runs(batches, ("kind", "shard", "block")):
        total = Counts()
        for part in parts:
            for k, v in zip(part.column("keys"), part.column("vals")):
                total.add(*_pair(k, v))
        keys, n = total.merged()
        keys, n = keys[n > 0], n[n > 0]
        for a in range(0, len(keys), 1 << 19):
            yield _rows({"kind": [kind], "block": [block], "shard": [shard], "keys": [keys[a: a + (1 << 19)].tobytes()], "vals": [_packed(n[a: a + (1 << 19)])]})


def merged(rows: DataFrame, salts: int) -> DataFrame:
    """The trie's and the vocabulary's parts, by shard; first by salted shard."""
    n = shuffle_partitions(rows.sparkSession)
    for salt in ([F.pmod(F.xxhash64("block"), F.lit(salts))] if salts > 1 else []) + [F.lit(0)]:
        rows = rows.withColumn("block", salt.cast("long")).repartition(n, "kind", "shard", "block").sortWithinPartitions("kind", "shard", "block")
        rows = rows.mapInArrow(_merge, _PARTS)
    return rows


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of context bytes and the bytes after them (order 1), the words'
    total and their number, of a partition of the merged rows."""
    pairs, total, distinct = Counts(), 0, 0
    for batch in batches:
        for kind, k, v in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "vals"))):
            if kind == GRAMS:
                pairs.add(*_distinct(_numbers(k) & ((1 << 18) - 1), _unpacked(v, len(k) // 8)))
            else:
                total, distinct = total + int(_unpacked(v, len(k) // 8).sum()), distinct + len(k) // 8
    keys, n = pairs.merged()
    yield pa.record_batch([pa.array([-1, -2, *keys.tolist()], pa.int64()), pa.array([total, distinct, *n.tolist()], pa.int64())], ["k", "n"])


class Level:
    """One order of the trie: grams with counts, contexts with totals, distinct
    symbols and the count that exclusion takes from the suffix."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, below: "Level | None"):
        self.grams, self.n = grams, n
        context = grams >> 9
        first = np.flatnonzero(np.diff(context, prepend=-1))
        self.contexts = context[first]
        self.total = np.add.reduceat(n, first) if len(first) else n
        self.distinct = np.diff(np.append(first, len(grams)))
        self.taken = np.zeros(len(first), np.int64)
        if below is not None and len(first):
            self.taken = np.add.reduceat(below.count(grams), first)

    def count(self, grams: np.ndarray) -> np.ndarray:
        """Counts of this order's suffixes of ``grams``."""
        return _lookup(self.grams, self.n, grams & self.mask)

    mask = -1

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        context = (grams & self.mask) >> 9
        return tuple(_lookup(self.contexts, x, context) for x in (self.total, self.distinct, self.taken))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Trie:
    """Code lengths from the counts of whole grams, and those of order 1."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        ends, m = _distinct(pairs & 511, n)
        self.low = [self._level(ends, m, 0, None)]
        self.low.append(self._level(pairs, n, 1, self.low[0]))
        self.levels = self.low

    @staticmethod
    def _level(grams: np.ndarray, n: np.ndarray, order: int, below: Level | None) -> Level:
        level = Level(grams, n, below)
        level.mask = (1 << 9 * (order + 1)) - 1
        return level

    def grown(self, grams: np.ndarray, n: np.ndarray) -> "Trie":
        """With the longer contexts of a shard."""
        self.levels = list(self.low)
        for order in range(2, ORDER + 1):
            keys, m = _distinct(grams & (1 << 9 * (order + 1)) - 1, n)
            self.levels.append(self._level(keys, m, order, self.levels[-1]))
        return self

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last symbol."""
        p = np.ones(len(grams))
        open_ = np.ones(len(grams), bool)
        taken, seen = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for level in reversed(self.levels):
            n = level.count(grams)
            total, distinct, more = level.of(grams)
            left, new = total - taken, distinct - seen  # without what longer contexts have
            whole = 2 * np.maximum(left, 1)
            known = distinct > 0
            p = np.where(open_ & known, p * np.where(n > 0, (2 * n - 1) / whole, np.where(left > 0, new / whole, 1.0)), p)
            open_ &= ~(known & (n > 0))
            taken, seen = np.where(known, more, 0), np.where(known, distinct, 0)
        p = np.where(open_, p / np.maximum(SYMBOLS - seen, 1), p)
        return np.log10(p)


def _answer(pairs: np.ndarray, n: np.ndarray):
    """Blocks' keys (side 1) against their shard of the model (side 0): code
    lengths of grams, counts of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at, model = Trie(pairs, n), None, None
        for (kind, shard, salt, side), parts in _runs(batches, ("kind", "shard", "salt", "side")):
            if (kind, shard, salt) != at:
                at, model = (kind, shard, salt), (np.zeros(0, np.int64),) * 2
            if side == 0:
                got = [_pair(k, v) for part in parts for k, v in zip(part.column("keys"), part.column("vals"))]
                model = _distinct(np.concatenate([k for k, _ in got]), np.concatenate([v for _, v in got]))
                continue
            if kind == GRAMS:
                trie.grown(*model)
            for part in parts:
                raw, block = part.column("keys").to_pylist(), part.column("block").to_pylist()
                ends = np.cumsum([len(r) // 8 for r in raw])
                a = 0
                while a < len(raw):  # rows of about STEP keys, one at least
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP)))
                    keys = _numbers(b"".join(raw[a:b]))
                    new = np.rint(trie.log10(keys) * UNIT).astype(np.int64) if kind == GRAMS else _lookup(*model, keys)
                    cuts = ends[a:b] - (ends[a - 1] if a else 0)
                    yield _rows({"kind": [kind] * (b - a), "block": block[a:b], "shard": [0] * (b - a), "keys": raw[a:b],
                                 "vals": [_packed(new[x:y]) for x, y in zip([0, *cuts[:-1]], cuts)]})
                    a = b
    return run


def _scored(total: int, distinct: int, end: int):
    """A block's answers (GRAMS, WORDS), then its texts, scored one by one."""
    def term(count: np.ndarray) -> np.ndarray:
        return np.rint(np.log10((count + 0.1) / (total + 0.1 * (distinct + 1))) * BASE_UNIT).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for (block, kind), parts in _runs(batches, ("block", "kind")):
            if block != at:
                at, known = block, {GRAMS: (np.zeros(0, np.int64),) * 2, WORDS: (np.zeros(0, np.int64),) * 2}
            if kind != TEXTS:
                got = [_pair(k, v) for part in parts for k, v in zip(part.column("keys"), part.column("vals"))]
                keys, vals = (np.concatenate(x) for x in zip(*got))
                order = np.argsort(keys)
                known[kind] = keys[order], vals[order]
                continue
            for part in parts:
                for packed, vals in zip(part.column("keys"), part.column("vals")):
                    ids, none, held, length = _numbers(vals.as_py()).reshape(4, -1)
                    data = np.frombuffer(pa.decompress(packed.as_py(), int(length.sum()), "zstd", asbytes=True), np.uint8)
                    yield _score(known, data, ids, none, held, np.concatenate(([0], np.cumsum(length))))

    def _score(known, data, ids, none, held, off) -> pa.RecordBatch:
        n = len(ids)
        score, base, tokens, seen = (np.zeros(n, np.int64) for _ in range(4))
        for group in groups(data[off[i]: off[i + 1]] for i in range(n)):
            owner = np.array(group.owner)
            gram, text = group.grams()
            both = np.sort(gram.astype(np.uint64) << np.uint64(_DOC) | text.astype(np.uint64))  # by gram, with the text beside it
            gram, text = (both >> np.uint64(_DOC)).astype(np.int64), (both & np.uint64((1 << _DOC) - 1)).astype(np.int64)
            first = np.flatnonzero(np.diff(gram, prepend=-1))
            each = np.repeat(_lookup(*known[GRAMS], gram[first]), np.diff(np.append(first, len(gram))))
            np.add.at(score, owner, np.bincount(text, each, minlength=len(owner)).astype(np.int64))
            word, text = group.words()
            one, back = np.unique(word, return_inverse=True)
            count = _lookup(*known[WORDS], one)
            np.add.at(base, owner, np.bincount(text, term(count)[back], minlength=len(owner)).astype(np.int64))
            np.add.at(tokens, owner, np.bincount(text, minlength=len(owner)))
            np.add.at(seen, owner, np.bincount(text, (count > 0)[back], minlength=len(owner)).astype(np.int64))
        base += term(np.array([end]))[0]
        return pa.record_batch([pa.array(ids, mask=none.astype(bool)), pa.array(held.astype(bool)), pa.array(tokens + 1), pa.array(seen + (end > 0)),
                                pa.array(np.full(n, total)), pa.array(base / BASE_UNIT), pa.array(score / UNIT)],
                               ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    of every row; ``held`` says which rows are not learned from."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = keyed(docs, id_col, text_col).withColumn("held", held_out() if held is None else held)
    parts = cut_lineage(rows.mapInArrow(_blocks, _PARTS))
    keys, texts = parts.where(F.col("kind") < TEXTS), parts.where(F.col("kind") == TEXTS)
    salts = max(1, n // SHARDS)
    model = cut_lineage(merged(keys, salts))
    few = {r.k: r.n for r in model.mapInArrow(_few, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # 258 * 258 rows and two at most
    words, distinct = few.pop(-1, 0), few.pop(-2, 0)
    pairs = np.array(sorted(few), np.int64)
    counts = np.array([few[k] for k in sorted(few)], np.int64)
    ends = int(counts[(pairs & 511) == END].sum())  # the end is a token: one a training text
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    asked = (model.select("kind", "block", "shard", every.alias("salt"), F.lit(0).alias("side"), "keys", "vals")
             .unionByName(keys.select("kind", "block", "shard", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), F.lit(1).alias("side"), "keys", F.lit(None).cast("binary").alias("vals"))))
    asked = asked.repartition(n, "kind", "shard", "salt").sortWithinPartitions("kind", "shard", "salt", "side")
    answers = asked.mapInArrow(_answer(pairs, counts), _PARTS)
    met = answers.unionByName(texts).repartition(n, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(_scored(words + ends, distinct + (ends > 0), ends),
                          "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _ppm_sql() -> str:
    """The same model in SQL: a text is a string of two-letter symbols, a gram
    five of them."""
    size = 2 * (ORDER + 1)
    out = [f"""g AS MATERIALIZED (SELECT doc_id, held, substr(h, 2 * i + 1, {size}) AS g FROM (SELECT doc_id, held, h, unnest(range((length(h) - {2 * ORDER}) // 2)) AS i
  FROM (SELECT doc_id, held, repeat('__', {ORDER}) || hex(encode(t)) || '$$' AS h FROM d))),
t{ORDER} AS MATERIALIZED (SELECT g AS x, count(*) AS n FROM g WHERE NOT held GROUP BY g)"""]
    for j in reversed(range(ORDER)):
        out.append(f"t{j} AS MATERIALIZED (SELECT substr(x, 3) AS x, sum(n) AS n FROM t{j + 1} GROUP BY ALL)")
    for j in range(ORDER + 1):
        taken = f"(SELECT left(a.x, {2 * j}) AS c, sum(b.n) AS e FROM t{j} a JOIN t{j - 1} b ON b.x = substr(a.x, 3) GROUP BY ALL)" if j else "(SELECT '' AS c, 0 AS e)"
        out.append(f"c{j} AS MATERIALIZED (SELECT c, total, known, e FROM (SELECT left(x, {2 * j}) AS c, sum(n) AS total, count(*) AS known FROM t{j} GROUP BY ALL) JOIN {taken} USING (c))")
    cols, joins, p, done = [], [], "1.0::DOUBLE", "FALSE"
    for j in reversed(range(ORDER + 1)):
        cols += [f"coalesce(t{j}.n, 0) AS n{j}", f"coalesce(c{j}.total, 0) AS c{j}", f"coalesce(c{j}.known, 0) AS d{j}", f"coalesce(c{j}.e, 0) AS e{j}"]
        joins.append(f"LEFT JOIN t{j} ON t{j}.x = right(q.g, {2 * (j + 1)}) LEFT JOIN c{j} ON c{j}.c = substr(q.g, {2 * (ORDER - j) + 1}, {2 * j})")
    steps = []
    for j in reversed(range(ORDER + 1)):
        left = f"(c{j} - {f'e{j + 1}' if j < ORDER else '0'})"
        new = f"(d{j} - {f'd{j + 1}' if j < ORDER else '0'})"
        steps.append(f"CASE WHEN ({done}) OR d{j} = 0 THEN 1.0::DOUBLE WHEN n{j} > 0 THEN (2 * n{j} - 1)::DOUBLE / (2 * {left}) WHEN {left} > 0 THEN {new}::DOUBLE / (2 * {left}) ELSE 1.0::DOUBLE END")
        done = f"{done} OR n{j} > 0"
    p = " * ".join(f"({s})" for s in steps) + f" * CASE WHEN {done} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / greatest({SYMBOLS} - d0, 1) END"
    out.append(f"l AS MATERIALIZED (SELECT g, round(log10({p}) * {UNIT:.0f})::BIGINT AS lp FROM (SELECT q.g, {', '.join(cols)} FROM (SELECT DISTINCT g FROM g) q {' '.join(joins)}))")
    out.append(f"s AS (SELECT doc_id, sum(lp)::BIGINT / {UNIT:.1f}::DOUBLE AS score FROM g JOIN l USING (g) GROUP BY doc_id)")
    return ",\n".join(out)


ORACLE_SQL = rf"""
WITH RECURSIVE ids AS (SELECT doc_id::VARCHAR AS s FROM documents),
{crc_sql('ids')},
d AS MATERIALIZED (SELECT doc_id, coalesce(v % 10 = 0, FALSE) AS held, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents LEFT JOIN crc ON crc.s = doc_id::VARCHAR),
{_ppm_sql()},
k AS MATERIALIZED (SELECT doc_id, held, unnest(list_append(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), ' ')) AS w FROM d),
v AS MATERIALIZED (SELECT w, count(*) AS c FROM k WHERE NOT held GROUP BY w),
m AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM v),
b AS (SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, sum(round(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1))) * {BASE_UNIT:.0f})::BIGINT)::BIGINT / {BASE_UNIT:.1f}::DOUBLE AS base_score
  FROM k LEFT JOIN v USING (w), m GROUP BY doc_id)
SELECT d.doc_id, d.held AS held_out, n_tokens, n_known, (SELECT n FROM m) AS train_tokens, base_score, score FROM d JOIN b USING (doc_id) JOIN s USING (doc_id)
"""
