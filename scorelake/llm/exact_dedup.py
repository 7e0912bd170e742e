"""Exact de-duplication through a cuckoo-filter index of live digests (op 10).

Every text is reduced to the SHA-256 of its bytes after lower-casing A-Z.
Digests are first grouped per (digest, salt) - a group with a third of all
rows is thus spread over ``SALTS`` keys and partly summed before it moves -
and then dealt by digest to tasks that each hold one ``CuckooIndex``. A lookup
goes to the filter's two buckets; a fingerprint hit is verified against the
full digest stored beside it. A row that outranks the live one deletes the
old entry and inserts its own. An overflowing filter doubles and is refilled
from the stored keys, so no key is lost.

Cases: null text counts as empty; empty texts are equal to each other; a null
``doc_id`` ranks below every other; rows that agree in id and text are copies
of which one is kept; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import cut_lineage, keyed, packed, unpacked, utf8

#: Keys over which the rows of one text are spread before they are joined.
SALTS = 32


@dataclass(slots=True)
class Entry:
    """Live digest: the id that stays, and how many rows share the text."""

    digest: bytes
    keep: int | None
    rows: int


class CuckooIndex:
    """Cuckoo filter (two buckets a key, ``SLOTS`` 16-bit fingerprints each)
    with the full keys stored slot by slot beside the fingerprints."""

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, buckets: int = 256):
        self.size = 0
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[Entry]] = [[] for _ in range(buckets)]
        self._turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[8:16], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def find(self, digest: bytes) -> Entry | None:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if mark in self.marks[bucket]:
                for m, entry in zip(self.marks[bucket], self.content[bucket]):
                    if m == mark and entry.digest == digest:
                        return entry
        return None

    def delete(self, digest: bytes) -> Entry | None:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for slot, (m, entry) in enumerate(zip(self.marks[bucket], self.content[bucket])):
                if m == mark and entry.digest == digest:
                    del self.marks[bucket][slot], self.content[bucket][slot]
                    self.size -= 1
                    return entry
        return None

    def insert(self, entry: Entry) -> None:
        """Add a key that is not in the index."""
        left = self._place(entry)
        if left is not None:
            self._grow([e for bucket in self.content for e in bucket] + [left])
        self.size += 1

    def _grow(self, keys: list[Entry]) -> None:
        """Double until all stored keys have a place."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._reset(buckets)
            if all(self._place(e) is None for e in keys):
                return

    def _place(self, entry: Entry) -> Entry | None:
        mark, a, b = self._places(entry.digest)
        for bucket in (a, b):
            if len(self.marks[bucket]) < self.SLOTS:
                self.marks[bucket].append(mark)
                self.content[bucket].append(entry)
                return None
        bucket = a
        for _ in range(self.MAX_KICKS):
            self._turn = (self._turn + 1) % self.SLOTS
            slot = self._turn
            mark, self.marks[bucket][slot] = self.marks[bucket][slot], mark
            entry, self.content[bucket][slot] = self.content[bucket][slot], entry
            bucket = self._other(bucket, mark)
            if len(self.marks[bucket]) < self.SLOTS:
                self.marks[bucket].append(mark)
                self.content[bucket].append(entry)
                return None
        return entry

    def add_rows(self, digest: bytes, doc_id: int | None, rows: int) -> None:
        """Count ``rows`` more copies; the largest id is the live one."""
        live = self.find(digest)
        if live is None:
            self.insert(Entry(digest, doc_id, rows))
        elif doc_id is not None and (live.keep is None or doc_id > live.keep):
            old = self.delete(digest)
            self.insert(Entry(digest, doc_id, old.rows + rows))
        else:
            live.rows += rows

    def __iter__(self) -> Iterator[Entry]:
        for bucket in self.content:
            yield from bucket


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        view = memoryview(data)
        shas = [hashlib.sha256(bytes(view[off[i]: off[i + 1]]).lower()).digest() for i in range(batch.num_rows)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(shas, pa.binary())], ["doc_id", "sha"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for sha, top, rows in zip(*(batch.column(c).to_pylist() for c in ("sha", "top", "rows"))):
            index.add_rows(sha, top, rows)
    found: list[Entry] = []
    for entry in index:
        found.append(entry)
        if len(found) == 8192:
            yield _entries(found)
            found = []
    if found:
        yield _entries(found)


def _entries(found: list[Entry]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([e.digest for e in found], pa.binary()), pa.array([e.keep for e in found], pa.int64()),
                            pa.array([e.rows for e in found], pa.int64())], ["sha", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 (see the module's text for nulls, ties and repeated rows)."""
    rows = keyed(docs, id_col, text_col).mapInArrow(_digests, "doc_id long, sha binary")
    rows = rows.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = cut_lineage(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))))
    parts = rows.groupBy("sha", "salt").agg(F.max("doc_id").alias("top"), F.sum("copies").alias("rows"))
    index = (parts.select("sha", "top", "rows").repartition("sha")
             .mapInArrow(_index, "sha binary, keep_id long, group_size long"))
    verdict = parts.select("sha", "salt").join(index, "sha")
    return (rows.join(verdict, ["sha", "salt"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, row), row being the caller's columns as one."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        view = memoryview(data)
        ids = batch.column("doc_id").to_pylist()
        keys = [hashlib.sha256(bytes(view[off[i]: off[i + 1]]).lower()).digest() + (b"n" if k is None else b"%d" % k) for i, k in enumerate(ids)]
        yield pa.record_batch([pa.array(keys, pa.binary()), batch.column("row"), batch.column("text")], ["key", "row", "text"])


def keep_last_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, all columns kept;
    they travel as one struct, so that their names don't matter."""
    key = F.concat(F.unhex("text_sha256"), F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), "utf-8"))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(key.alias("key"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), packed(docs, text_col).alias("row"))
    rows = rows.mapInArrow(_with_key, T.StructType([T.StructField("key", T.BinaryType()), rows.schema["row"], rows.schema["text"]]))
    rows = rows.join(kept, "key").dropDuplicates(["key"])
    return rows.select(*unpacked(docs, text_col, "row", F.col("text")))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM n
"""
