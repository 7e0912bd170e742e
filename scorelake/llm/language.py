"""Language identification with language-bitmask n-gram filters (op 7).

Texts are reduced to lower-case letters with every other run of characters as
spaces; their 4-byte n-grams (no space inside) are the evidence. For each
learned language a Bloom filter holds the n-grams that belong to it. The
filters are bit-sliced: one table of slots, each slot a bit mask over
languages, so that ``HASHES`` look-ups and one AND give all languages that
contain an n-gram. A language's popcount over a text, corrected for its
filter's false positives, is its evidence; the largest wins (ties: the
language with more training text, then the smaller name).

Learning counts n-grams per language inside the tasks and sums them by key,
over all rows that may be learned from. An n-gram belongs to a language if it
makes up at least ``FLOOR`` of that language's n-grams - so at most 1 / FLOOR
do, which bounds filter and broadcast whatever the corpus - and its share
there is at least ``SHARE`` of the largest among the languages.

Cases: null texts and texts without a letter are ``und`` with score 0; a text
with letters but no known n-gram gets the language with most training text;
without anything to learn from all are ``und``; repeated rows are predicted
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import chunks, mix64, utf8

HASHES = 3
FLOOR = 4e-6
SHARE = 0.2
#: Slots per n-gram of the fullest filter.
SLOTS_PER_GRAM = 12


def _letters() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_FOLD = _letters()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of consecutive texts (each padded by a space on both
    sides) and the index of each one's text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    text = _FOLD[data]
    low = np.zeros(len(data), bool)  # capital letters of the Latin-1 block: C3 80..9E
    if len(data) > 1:
        low[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    text[low] += 32
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    padded[np.arange(len(data)) + 2 * owner + 1] = text
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    if len(padded) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    wide = padded.astype(np.uint32)
    gram = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    whose = np.repeat(np.arange(n), size + 2)
    good = (padded[1:-2] != 32) & (padded[2:-1] != 32) & (np.arange(len(gram)) + 4 <= ends[whose[:-3]])
    return gram[good], whose[:-3][good]


def _slots(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix64(gram)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    """Bit-sliced filters: ``masks[w][slot]`` has a bit per language of word w."""

    langs: list[str]  # by training text, most first
    masks: list[np.ndarray]
    false: np.ndarray  # each filter's false-positive rate

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected popcounts, one row a text."""
        n = len(offsets) - 1
        gram, whose = grams(data, offsets)
        out = np.zeros((n, len(self.langs)))
        if not len(gram):
            return out
        total = np.bincount(whose, minlength=n)
        places = _slots(gram, len(self.masks[0]))
        for w, mask in enumerate(self.masks):
            found = mask[places[0]]
            for p in places[1:]:
                found = found & mask[p]
            for bit in range(min(32, len(self.langs) - 32 * w)):
                k = 32 * w + bit
                hits = np.bincount(whose[(found >> np.uint32(bit)) & np.uint32(1) == 1], minlength=n)
                out[:, k] = np.maximum(hits - total * self.false[k], 0) / (1 - self.false[k])
        return out


def fit(docs: DataFrame) -> Filters | None:
    """Learn from ``docs`` (text, lang), all rows with a non-null ``lang``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts):
            g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            g, at = np.unique(g, return_inverse=True)
            return g, np.bincount(at, weights=c).astype(np.int64)

        for batch in batches:
            data, off = utf8(batch.column("text"))
            code = batch.column("lang").dictionary_encode()
            names, index = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
            for a, b in chunks(off):
                gram, whose = grams(data[off[a]: off[b]], off[a: b + 1] - off[a])
                key, c = np.unique(gram.astype(np.uint64) | index[a:b][whose].astype(np.uint64) << np.uint64(32), return_counts=True)
                lang = key >> np.uint64(32)
                for k in np.unique(lang):
                    own = lang == k
                    parts = held.setdefault(names[int(k)], [])
                    parts.append(((key[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), c[own]))
                    if len(parts) > 8:
                        held[names[int(k)]] = [merge(parts)]
        for name, parts in held.items():
            g, c = merge(parts)
            yield pa.record_batch([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    rows = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("in"))  # a row per language at most
    counts = counts.persist()
    totals = {r.lang: r.n for r in counts.select(F.explode("in").alias("e")).groupBy("e.lang").agg(F.sum("e.n").alias("n")).collect()}
    if not totals:
        counts.unpersist()
        return None
    langs = sorted(totals, key=lambda k: (-totals[k], k))
    scale = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(1.0 / totals[k]))])
    share = counts.select("gram", F.transform("in", lambda e: F.struct(e["lang"].alias("lang"), (e["n"] * scale[e["lang"]]).alias("p"))).alias("in"))
    top = F.array_max(F.transform("in", lambda e: e["p"]))
    member = share.withColumn("top", top).select("gram", F.explode(F.filter("in", lambda e: (e["p"] >= FLOOR) & (e["p"] >= SHARE * F.col("top")))).alias("e"))
    member = member.select("gram", F.col("e.lang").alias("lang"))
    found = member.groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).collect()  # 1 / FLOOR n-grams a language at most
    counts.unpersist()
    most = max((len(r.grams) for r in found), default=1)
    slots = 1 << max(10, int(np.ceil(np.log2(SLOTS_PER_GRAM * most))))
    masks = [np.zeros(slots, np.uint32) for _ in range((len(langs) + 31) // 32)]
    false = np.zeros(len(langs))
    for r in found:
        k = langs.index(r.lang)
        bit = np.uint32(1 << (k % 32))
        for p in _slots(np.array(r.grams, np.uint32), slots):
            masks[k // 32][p] |= bit
        false[k] = np.mean(masks[k // 32] & bit != 0) ** HASHES
    return Filters(langs, masks, false)


def held_out() -> F.Column:
    """Documents that are not learned from: crc32(doc_id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text is used."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # size bounded by FLOOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            letter = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\pL"), False).to_numpy(zero_copy_only=False)
            if model is None:
                best, score = np.full(n, "und", object), np.zeros(n)
            else:
                data, off = utf8(batch.column("text"))
                e = np.concatenate([model.evidence(data[off[a]: off[b]], off[a: b + 1] - off[a]) for a, b in chunks(off)] or [np.zeros((0, len(model.langs)))])
                total = e.sum(1)
                top = e.argmax(1)
                best = np.array(model.langs, object)[top]
                score = np.where(total > 0, e[np.arange(n), top] / np.maximum(total, 1e-9), 1 / len(model.langs))
                best[~letter], score[~letter] = "und", 0.0
            yield pa.record_batch([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held-out rows and rows without a
    ``lang`` are predicted, not learned from."""
    filters = fit(docs.where(~held_out()).select("text", "lang"))
    return identify(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
