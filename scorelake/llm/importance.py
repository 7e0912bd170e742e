"""Importance resampling towards a target distribution (op 13).

A text's features are its runs of one to three consecutive words, hashed into
``BUCKETS`` buckets; a bucket's gain is the log ratio of its smoothed shares in
the target texts and in all documents, in thousandths, rounded down. A
document's weight is the sum of gains over its features. Weights with Gumbel
noise, seeded by id, are scores; the highest are drawn, which samples without
replacement in proportion to the importance weights.

The sum is bit-sliced. A document's bucket counts become planes: bit b of plane
j is bit j of the count in bucket b. The gains become planes too, in two's
complement, so that the last one counts negative. Then::

    weight = sum over j, k of 2**(j + k) * popcount(counts[j] & gains[k])

with the sign of the last gain plane: whole numbers, exact and the same in any
order. Bucket totals are added up inside the tasks (one row per task and bucket
goes to the shuffle), and only the ``BUCKETS`` totals reach the driver. Texts
are read twice and never shuffled. Ranks come from ranges of the score: a sort
inside each, and the running count of the ranges before it.

Cases: null, empty and blank texts have no features, weight 0 and no rank; a
null id draws its noise as an empty text and comes last among ties; repeated
rows have equal scores and ranks in any order; texts of any length are handled
whole, their words in blocks (a text's bytes and the places of its words are
held, about ten bytes for one of the text); other columns are not read; an
empty table gives an empty result, empty target texts only smoothed shares.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import chunks, cut_lineage, keyed, lower_ascii, shuffle_partitions, utf8

BUCKETS = 10_000
#: Longest run of words, and words of a text that a draw needs.
RUN, LEAST_WORDS = 3, 20
#: Documents whose counts are held as one dense table.
GROUP = 64
#: Words of a text that are hashed at a time.
BLOCK = 1 << 17

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_ONES = np.uint32(0xFFFFFFFF)


class Crc32:
    """CRC-32 of concatenations, from those of the parts.

    The register is linear over GF(2): running on by d zero bytes maps it by a
    matrix, kept as four byte tables. ``raw`` values start from register 0 and
    are not inverted at the end.
    """

    NEAR = 256

    def __init__(self):
        one = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
        self._zero = one
        tail = [one]  # tail[d][b]: byte b with d zero bytes after it
        for _ in range(self.NEAR - 1):
            tail.append(self._step(tail[-1]))
        self.tail = np.stack(tail)
        unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        shift = [unit]
        for _ in range(self.NEAR - 1):
            shift.append(self._step(shift[-1]))
        self.shift = np.stack(shift)  # [d][i][b]: byte i of the register, moved on by d zero bytes
        self.far = [self._step(shift[-1])]  # moves by NEAR * 2**p
        for _ in range(40):
            last = self.far[-1]
            self.far.append(self._by(last, last))

    def _step(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint32(8)) ^ self._zero[x & np.uint32(255)]

    @staticmethod
    def _by(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 255] ^ table[1][(x >> np.uint32(8)) & 255] ^ table[2][(x >> np.uint32(16)) & 255] ^ table[3][x >> np.uint32(24)]

    def moved(self, raw: np.ndarray, by: np.ndarray) -> np.ndarray:
        """``raw`` values after ``by`` zero bytes."""
        near = by & (self.NEAR - 1)
        t = self.shift.reshape(-1)
        at = near << 10
        out = t[at | (raw & 255)] ^ t[at | 256 | ((raw >> np.uint32(8)) & 255)] ^ t[at | 512 | ((raw >> np.uint32(16)) & 255)] ^ t[at | 768 | (raw >> np.uint32(24))]
        far = by >> 8
        p = 0
        while far.any():
            on = (far & 1) == 1
            out[on] = self._by(self.far[p], out[on])
            far, p = far >> 1, p + 1
        return out

    def of_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw values of data[begin: end]; words don't overlap and aren't empty."""
        length = end - begin
        if not len(begin):
            return np.zeros(0, np.uint32)
        cuts = np.concatenate(([0], np.cumsum(np.minimum(length, self.NEAR))))
        n = int(cuts[-1])
        owner = np.repeat(np.arange(len(begin)), np.diff(cuts))
        back = cuts[owner + 1] - 1 - np.arange(n)  # distance from the word's end
        out = np.bitwise_xor.reduceat(self.tail[back, data[end[owner] - 1 - back]], cuts[:-1])
        for i in np.flatnonzero(length > self.NEAR):
            out[i] = zlib.crc32(data[begin[i]: end[i]].tobytes(), 0xFFFFFFFF) ^ 0xFFFFFFFF
        return out

    def finished(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        return raw ^ self.moved(np.full(len(raw), _ONES), length) ^ _ONES


_crc: list[Crc32] = []


def crc() -> Crc32:
    if not _crc:
        _crc.append(Crc32())
    return _crc[0]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all words of consecutive lower-cased texts, and each
    text's first word (n + 1 bounds)."""
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets)


def feature_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's index, bucket) of every feature of consecutive lower-cased
    texts, a block of words at a time."""
    begin, end, bounds = _words(data, offsets)
    c = crc()
    for a in range(0, len(begin), BLOCK):
        b = min(a + BLOCK, len(begin))
        more = min(b + RUN - 1, len(begin))  # a run belongs to the block of its first word
        raw = c.of_words(data, begin[a:more], end[a:more])
        size = end[a:more] - begin[a:more]
        spaced = c.moved(np.full(len(raw), c.tail[0, 32], np.uint32), size) ^ raw  # " word"
        owner = np.searchsorted(bounds, np.arange(a, more), side="right") - 1
        run, length, n = raw[: b - a], size[: b - a], b - a
        yield owner[:n], c.finished(run, length) % BUCKETS
        for k in range(1, RUN):
            n = min(n, len(raw) - k)
            run, length = c.moved(run[:n], size[k: k + n] + 1) ^ spaced[k: k + n], length[:n] + 1 + size[k: k + n]
            inside = owner[:n] == owner[k: k + n]
            yield owner[:n][inside], c.finished(run[inside], length[inside]) % BUCKETS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Bounded groups of rows: the rows, their lower-cased bytes, offsets."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for a, b in chunks(off):
            yield batch.slice(a, b - a), lower_ascii(data[off[a]: off[b]]), off[a: b + 1] - off[a]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for _, data, off in _texts(batches):
        for _, bucket in feature_buckets(data, off):
            total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def bucket_totals(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; added up in the tasks and by a shuffle."""
    parts = texts.mapInArrow(_totals, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():  # BUCKETS rows at most, whatever the input
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, target to source."""
    s, t = float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + BUCKETS) / ((source + 1.0) * (t + BUCKETS)))).astype(np.int64)


def planes(values: np.ndarray, count: int) -> np.ndarray:
    """Bits 0 .. count - 1 of rows of whole numbers, negative ones in two's
    complement: (rows, count, words of 64 buckets)."""
    rows, n = values.shape
    padded = np.zeros((rows, -(-n // 64) * 64), values.dtype)
    padded[:, :n] = values
    bits = [np.packbits(((padded >> values.dtype.type(k)) & values.dtype.type(1)).astype(bool), axis=1, bitorder="little") for k in range(count)]
    return np.stack(bits, axis=1).view(np.uint64) if count else np.zeros((rows, 0, padded.shape[1] // 64), np.uint64)


class GainPlanes:
    """Signed gain planes; ``weigh`` gives exact sums of gains over counts."""

    def __init__(self, gain: np.ndarray):
        width = max(int(gain.max(initial=0)).bit_length(), int(-gain.min(initial=0) - 1).bit_length() if gain.min(initial=0) < 0 else 0) + 1
        self.planes = planes(gain[None, :], width)[0]
        self.sign = [(-1 if k == width - 1 else 1) << k for k in range(width)]

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """counts: (rows, BUCKETS), not negative."""
        most = int(counts.max(initial=0))
        bits = planes(counts.astype(np.min_scalar_type(most)), most.bit_length())
        out = np.zeros(len(counts), np.int64)
        for k, gain in enumerate(self.planes):
            found = np.bitwise_count(bits & gain).sum(2, dtype=np.int64)  # (rows, planes of counts)
            out += self.sign[k] * (found << np.arange(bits.shape[1])).sum(1)
        return out


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = GainPlanes(gain)
        for rows, data, off in _texts(batches):
            n = rows.num_rows
            features, words, weight = np.zeros(n, np.int64), np.diff(_words(data, off)[2]), np.zeros(n, np.int64)
            for a in range(0, n, GROUP):
                b = min(a + GROUP, n)
                counts = np.zeros((b - a) * BUCKETS, np.int64)
                for owner, bucket in feature_buckets(data[off[a]: off[b]], off[a: b + 1] - off[a]):
                    counts += np.bincount(owner * BUCKETS + bucket, minlength=len(counts))
                counts = counts.reshape(b - a, BUCKETS)
                features[a:b], weight[a:b] = counts.sum(1), sliced.weigh(counts)
            yield pa.record_batch([rows.column("doc_id"), pa.array(features), pa.array(words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])
    return run


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight of every row of ``docs``: how much
    more its features belong to the texts of ``target`` (column ``text``)."""
    rows = keyed(docs, id_col, text_col)
    wanted = target.select(F.col("text").cast("string").alias("text"))
    gain = gains(bucket_totals(rows.select("text")), bucket_totals(wanted))
    return rows.mapInArrow(_weigh(gain), "doc_id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every row; of
    those with ``LEAST_WORDS`` words ``percent`` in 100 are drawn and ranked."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, target, id_col, text_col).withColumn("score", F.col("weight") + gumbel.cast("long"))
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    scored = scored.withColumn("able", F.col("n_words") >= LEAST_WORDS)
    ranged = cut_lineage(scored.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    # as many rows as there are shuffle partitions, at most
    parts = ranged.where("able").groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"), F.expr(f"(sum(rows) over ()) * {int(percent)} div 100").alias("draw"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    rank = F.when(F.col("able") & (place <= F.col("draw")), place.cast("long"))
    return ranged.join(F.broadcast(parts), "part", "left").select("doc_id", "n_features", "n_words", "weight", "score", rank.alias("rank"))


#: CRC-32 by its linearity: a byte's remainder moved on by the bytes after it,
#: added up without carry. ``crc_sql(texts)`` gives relations ending in
#: ``crc(s, v)`` for the distinct texts of a relation ``texts(s)``.
def crc_sql(texts: str) -> str:
    return f"""
crc_in AS MATERIALIZED (SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM {texts})),
crc_bit(i, b, v) AS (SELECT 0, b, b::BIGINT FROM range(256) t(b) UNION ALL
  SELECT i + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bit WHERE i < 8),
crc_one AS MATERIALIZED (SELECT b, v FROM crc_bit WHERE i = 8),
crc_tail(d, b, v) AS (SELECT 0, b, v FROM crc_one UNION ALL
  SELECT d + 1, t.b, xor(t.v >> 8, o.v) FROM crc_tail t JOIN crc_one o ON o.b = t.v & 255 WHERE d < (SELECT max(n) FROM crc_in)),
crc_init(d, v) AS (SELECT 0, 4294967295::BIGINT UNION ALL
  SELECT d + 1, xor(t.v >> 8, o.v) FROM crc_init t JOIN crc_one o ON o.b = t.v & 255 WHERE d < (SELECT max(n) FROM crc_in)),
crc_byte AS (SELECT s, n, n - 1 - i AS d, ('0x' || substr(h, 2 * i + 1, 2))::INT AS b FROM (SELECT s, h, n, unnest(range(n)) AS i FROM crc_in)),
crc AS MATERIALIZED (SELECT c.s, xor(xor(bit_xor(t.v), any_value(j.v)), 4294967295) AS v FROM crc_byte c JOIN crc_tail t ON t.d = c.d AND t.b = c.b JOIN crc_init j ON j.d = c.n GROUP BY c.s)"""


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT 'd' AS kind, doc_id AS id, {_WORDS_SQL} AS w FROM documents UNION ALL SELECT 'b', item_id, {_WORDS_SQL} FROM benchmark),
u AS (SELECT kind, id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS MATERIALIZED (SELECT kind, id, s, count(*) AS n FROM (
    SELECT kind, id, w[i] AS s FROM u UNION ALL SELECT kind, id, w[i] || ' ' || w[i + 1] FROM u WHERE i < len(w)
    UNION ALL SELECT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM u WHERE i + 1 < len(w)) GROUP BY ALL),
{crc_sql('f')},
g AS MATERIALIZED (SELECT kind, id, v % 10000 AS b, sum(n) AS n FROM f JOIN crc USING (s) GROUP BY ALL),
t AS (SELECT b.b, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM range(10000) b(b) LEFT JOIN g ON g.b = b.b GROUP BY b.b),
a AS (SELECT *, (sum(s) OVER ()) AS ss, (sum(t) OVER ()) AS tt FROM t),
gain AS (SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS gain FROM a),
x AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN gain USING (b) WHERE kind = 'd' GROUP BY id),
y AS (SELECT w.id AS doc_id, len(w.w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('42:' || w.id::VARCHAR), 1, 8))::BIGINT AS h FROM w LEFT JOIN x ON x.id = w.id WHERE kind = 'd'),
z AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM y),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM z WHERE words >= 20)
SELECT z.doc_id, n_features, words::BIGINT AS n_words, weight, score, CASE WHEN place <= able * 5 // 100 THEN place END::BIGINT AS rank FROM z LEFT JOIN r ON r.doc_id = z.doc_id
"""
