"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import cut_lineage, ensure_checkpoint_dir, shared_path  # noqa: F401

#: Texts are handled in groups of about this many bytes, so that a task's
#: numpy buffers stay small whatever the batch holds.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), under fixed names: other columns, whatever they
    are called, never meet the operators' own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def packed(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct, its fields named by place, so
    that no name of the caller's meets an operator's own."""
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    return F.struct(*fields, F.lit(0).alias("n"))


def unpacked(docs: DataFrame, text_col: str, row: str, text: Column) -> list[Column]:
    """The columns of ``docs`` from what ``packed`` made of them and a text."""
    return [(text.cast(docs.schema[c].dataType) if c == text_col else F.col(row).getField(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def squeeze(raw) -> bytes:
    """Compressed bytes, for what travels; ``unsqueeze`` gives them back."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if len(raw) else b""


def unsqueeze(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True) if packed else b""


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``size`` bytes, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, well spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, and
    for each text the index of its first word (n + 1 bounds).

    A word's hash is a polynomial over its bytes modulo 2**64, finished with
    its length by ``mix64``: equal words have equal hashes anywhere.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = _IS_WORD[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    starts[inner] |= word[inner]
    begin = np.flatnonzero(starts)
    ends = word.copy()
    ends[:-1] &= ~word[1:] | starts[1:]
    end = np.flatnonzero(ends) + 1
    length = end - begin
    # sum of byte * B**(position in word): one ragged power table, one reduceat
    pos = np.arange(n, dtype=np.int64)
    first = np.repeat(begin, length)
    at = pos[word] - first
    power = _powers(int(length.max()) if len(length) else 1)
    terms = (data[word].astype(np.uint64) + np.uint64(1)) * power[at]
    cuts = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else np.zeros(0, np.int64)
    sums = np.add.reduceat(terms, cuts) if len(length) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(begin, offsets).astype(np.int64)
    return mix64(sums ^ (length.astype(np.uint64) << np.uint64(48))), bounds


def ragged(bounds: np.ndarray, i: int) -> slice:
    return slice(int(bounds[i]), int(bounds[i + 1]))
