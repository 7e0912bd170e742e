"""Quality classifier: regularised quadratic discriminant (op 8).

A text becomes ``len(FEATURES)`` statistics, log- or logit-transformed: shares
of character classes, word and line repetition, lengths. Each class gets a
mean and a covariance shrunk towards the pooled covariance and its diagonal;
their Cholesky factors are computed once. A text's score is the logistic of
the difference of the two Mahalanobis log densities plus the log prior odds.

Fitting needs only sums of x and x*x' per class, added up inside the tasks:
all labelled rows take part and the driver gets two rows. Statistics are
written once to the shared folder and read for fitting and for scoring.

Cases: a null text counts as empty, and an empty one is scored from its
counts, all zero; repeated rows are scored alike; rows without a label don't
take part in fitting; with labels of one class or none the score is the prior
(0.5 without labels); an empty table gives an empty result; a null ``doc_id``
is never held out and never labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import chunks, cut_lineage, keyed, utf8, word_hashes

FEATURES = ("words", "chars_a_word", "upper", "digits", "symbols", "bars", "stops", "non_ascii", "lines_a_word",
            "distinct_words", "doubled_words", "distinct_triples", "distinct_lines", "bare_words")

#: Units of the usual share that every text gets besides its own (see _logit).
WORDS_MORE, CHARS_MORE = 20.0, 100.0
#: Shares of the pooled covariance and of its diagonal in a class covariance.
POOLED, DIAGONAL = 0.10, 0.05

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _BAR, _SYMBOL, _LEAD, _TAIL = range(9)


def _classes() -> np.ndarray:
    kind = np.full(256, _SYMBOL, np.uint8)
    for chars, k in ((range(97, 123), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT), ((9, 10, 11, 12, 13, 32), _SPACE),
                     (b".,;:'\"?()-", _STOP), (b"|", _BAR), (range(192, 256), _LEAD), (range(128, 192), _TAIL)):
        kind[list(chars)] = k
    return kind


_KIND = _classes()


def _logit(part: np.ndarray, whole: np.ndarray, usual: float, weight: float) -> np.ndarray:
    """Log odds of a share, with ``weight`` more units of the ``usual`` share:
    a text of a few words is then not an extreme one."""
    part = np.minimum(part, whole)
    return np.log((part + weight * usual) / (whole - part + weight * (1 - usual)))


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each owner (owners ascend)."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def _line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each non-empty line and its text's index."""
    brk = data == 10
    start = np.zeros(len(data), bool)
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    start[1:] |= brk[:-1]
    at = np.flatnonzero(start)
    weight = (np.arange(len(data), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(data)))).astype(np.uint64))
    h = (data.astype(np.uint64) + np.uint64(7)) * ((weight * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h[brk] = 0
    sums = np.add.reduceat(h, at)
    owner = np.searchsorted(offsets, at, side="right") - 1
    return sums[sums != 0], owner[sums != 0]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of consecutive texts, one row a text."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(owner * 9 + _KIND[data], minlength=9 * n).reshape(n, 9)
    chars = count.sum(1) - count[:, _TAIL]
    ink = chars - count[:, _SPACE]
    hashes, bounds = word_hashes(data, offsets)
    words = np.diff(bounds)
    word_owner = np.repeat(np.arange(n), words)
    distinct = _distinct(hashes, word_owner, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    doubled = np.bincount(word_owner[same], minlength=n)
    if len(hashes) > 2:
        triple = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[2:] * np.uint64(0xD6E8FEB86659FD93)
        inside = word_owner[:-2] == word_owner[2:]
        triples, distinct3 = np.maximum(words - 2, 0), _distinct(triple[inside], word_owner[:-2][inside], n)
    else:
        triples = distinct3 = np.zeros(n, np.int64)
    if len(data):
        line, line_owner = _line_hashes(data, offsets)
        lines, distinct_l = np.bincount(line_owner, minlength=n), _distinct(line, line_owner, n)
        letter = np.concatenate(([0], np.cumsum((_KIND[data] <= _DIGIT) | (_KIND[data] >= _LEAD))))
        ws = _KIND[data] == _SPACE
        first = ~ws
        first[1:] &= ws[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        first[inner] |= ~ws[inner]
        begin = np.flatnonzero(first)
        nxt = np.append(begin[1:], len(data))
        bare = np.bincount(word_owner, weights=(letter[nxt] - letter[begin]) == 0, minlength=n)
    else:
        lines = distinct_l = bare = np.zeros(n)
    word_share = lambda part, whole, usual: _logit(part, whole, usual, WORDS_MORE)
    char_share = lambda part, usual: _logit(part, ink, usual, CHARS_MORE)
    return np.column_stack([
        np.log(words + WORDS_MORE), np.log((ink + CHARS_MORE) / (words + WORDS_MORE)), char_share(count[:, _UPPER], 0.03),
        char_share(count[:, _DIGIT], 0.02), char_share(count[:, _SYMBOL], 0.005), char_share(count[:, _BAR], 0.002),
        char_share(count[:, _STOP], 0.03), char_share(count[:, _LEAD], 0.03), word_share(lines, words, 0.1),
        word_share(distinct, words, 0.9), word_share(doubled, words, 0.01), word_share(distinct3, triples, 0.98),
        word_share(distinct_l, lines, 0.98), word_share(bare, words, 0.01)])


def _each(batch: pa.RecordBatch, fn) -> np.ndarray:
    """``fn(data, offsets)`` over a batch's texts, in bounded groups."""
    data, off = utf8(batch.column("text"))
    return np.concatenate([fn(data[off[a]: off[b]], off[a: b + 1] - off[a]) for a, b in chunks(off)] or [np.zeros((0, len(FEATURES)))])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _each(batch, statistics)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([batch.column("doc_id"), values], ["doc_id", "x"])

    return keyed(docs).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Fitted model; ``score`` needs no Spark."""

    prior: float
    parts: list[tuple[np.ndarray, np.ndarray, float]] | None  # mean, inverse Cholesky factor, log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        log = [-0.5 * (np.square((x - mean) @ inv.T).sum(1) + logdet) for mean, inv, logdet in self.parts]
        odds = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on the rows of ``stats`` (doc_id, x) that ``labels`` marks 0 or 1."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                v = x[y == c]
                total[c] += np.concatenate(([len(v)], v.sum(0), (v.T @ v).ravel()))
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["y", "s"])

    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    parts = stats.join(marks, "doc_id").select("y", "x").mapInArrow(sums, "y int, s array<double>")
    flat = parts.select("y", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in flat.collect():  # 2 * (1 + d + d * d) rows, whatever the input
        total[r.y, r.i] = r.v
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5, None)
    mean = total[:, 1: 1 + d] / n[:, None]
    cov = [total[c, 1 + d:].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    parts_out = []
    for c in (0, 1):
        shrunk = (1 - POOLED - DIAGONAL) * cov[c] + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        chol = np.linalg.cholesky(shrunk)
        parts_out.append((mean[c], np.linalg.inv(chol), 2 * float(np.log(np.diag(chol)).sum())))
    return Discriminant(float(n[1] / n.sum()), parts_out)


def held_out() -> F.Column:
    """Documents of which no label is learned: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; held-out rows never
    take part in fitting."""
    stats = cut_lineage(text_statistics(docs))
    model = fit(stats.where(~held_out()), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored under 0.5; texts are not shuffled, as
    the second pass computes the statistics again in place."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    model = fit(text_statistics(docs).where(~held_out()), marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for a, b in chunks(off):  # a slice at a time: what leaves is never a copy of the whole batch
                x = statistics(data[off[a]: off[b]], off[a: b + 1] - off[a])
                yield batch.slice(a, b - a).filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
