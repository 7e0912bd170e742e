"""WARC archives: deduplicating writer and salvage reader (op 3).

Writing. Pages are reduced to the SHA-1 of their payload; of equal payloads
the largest page_id is the response and the others are revisit records that
refer to it. Digests are first grouped per (digest, salt), so that a payload
shared by a third of all pages is not one group. Every task writes archives of
gzip members, one per record, under names of its own in the shared folder, and
returns a manifest; only files that the manifest of a finished task names are
read, so a lost executor's files don't count.

Reading. A record is taken if its member inflates, its header parses with all
its fields, its length fits and the digests of block and header agree (the
writer adds one of the header, which plain records don't have otherwise). The
rows hold url and payload. After a failed check the reader
searches for the next gzip member or version line and goes on there; the
bytes in between are logged as a gap (path, offset, length, reason). Both
compressed and plain records are read. A file is read in blocks, and one
record at a time is held. A ``strict`` reader compares the records of each
archive with the manifest's and fails where any is missing: so it reads what was
just written, where a gap would be a loss and not damage of long ago.

Cases: a null payload counts as empty; ``min_bytes`` is the size under which
equal payloads are not revisits; rows that agree in id and payload are copies,
of which one is the response; a null page_id ranks below every other; a null
url is written as none; an empty table writes nothing; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import cut_lineage, shared_path, shuffle_partitions, utf8

SALTS = 32
#: A task begins another archive after about so many compressed bytes.
ROLL_BYTES = 64 << 20
BLOCK = 1 << 20
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."

MANIFEST = "path string, bytes long, records long"
ROW = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, "
       "path string, at long, length long, gap string")
#: Bytes of payloads that a batch of rows holds.
BATCH_BYTES = 4 << 20


def base32_sha1(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record's header and block; the digest and length are the full payload's."""
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {revisit}')}>",
            f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    head.append(f"WARC-Header-Digest: sha1:{base32_sha1(chr(10).join(head).encode())}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Appends gzip members to archives under ``base`` and rolls them."""

    def __init__(self, base: str):
        self.fs, self.base = pafs.FileSystem.from_uri(base)
        self.uri, self.out, self.done = base, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(self.base, recursive=True)
            self.out, self.size, self.count = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None), 0, 0
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.size += len(member)
        self.count += 1
        if self.size >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.uri}/{self.name}", self.size, self.count))
            self.out = None


class _Bytes:
    """A file's bytes by offset, read in blocks."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.block = handle, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        if not self.start <= pos or pos + n > self.start + len(self.block):
            self.handle.seek(pos)
            self.start, self.block = pos, self.handle.read(max(n, BLOCK))
        return self.block[pos - self.start: pos - self.start + n]

    def find(self, pos: int) -> int:
        """Offset of the next member or version line from ``pos`` on, or the end."""
        while pos < self.size:
            part = self.at(pos, min(BLOCK, self.size - pos))
            hits = [h for h in (part.find(_MAGIC), part.find(_VERSION)) if h >= 0]
            if hits:
                return pos + min(hits)
            if pos + len(part) >= self.size:
                break
            pos += max(1, len(part) - len(_VERSION))
        return self.size


def _parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("malformed header")
        fields[name.strip().lower()] = value.strip()
    return fields


def _checked(fields: dict[str, str], block: bytes, head: bytes) -> dict:
    """The record's fields, all parsed and compared with the digests."""
    want = fields.get("warc-block-digest", "")
    if want and want != "sha1:" + base32_sha1(block):
        raise ValueError("block digest differs")
    lines = head.decode("utf-8").split("\r\n")
    want = fields.get("warc-header-digest", "")
    if want and want != "sha1:" + base32_sha1("\n".join(x for x in lines if not x.lower().startswith("warc-header-digest:")).encode()):
        raise ValueError("header digest differs")
    kind = fields.get("warc-type")
    revisit = kind == "revisit"
    payload_bytes = _whole(fields, "warc-payload-length") if revisit else len(block)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(block)  # the payload itself decides
    return {"fields": fields, "block": block, "page_id": _whole(fields, "warc-page-id"), "url": fields.get("warc-target-uri"), "kind": kind,
            "payload": None if revisit else block, "payload_bytes": payload_bytes, "digest": digest, "refers_to": _whole(fields, "warc-refers-to-page") if revisit else None}


def _whole(fields: dict[str, str], name: str) -> int | None:
    """A field's whole number, None if it is empty or absent."""
    text = fields.get(name)
    if not text:
        return None
    if not re.fullmatch(r"-?[0-9]{1,19}", text) or not -(1 << 63) <= int(text) < 1 << 63:
        raise ValueError(f"{name} is no whole number")
    return int(text)


def _member(src: _Bytes, pos: int) -> tuple[dict, int]:
    """The record in the gzip member at ``pos``, and where the member ends."""
    z, got, at = zlib.decompressobj(31), [], pos
    while not z.eof:
        part = src.at(at, min(BLOCK // 16, src.size - at))
        if not part:
            raise ValueError("truncated member")
        try:
            got.append(z.decompress(part))
        except zlib.error as e:
            raise ValueError("damaged member") from e
        at += len(part)
    data = b"".join(got)
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no header")
    fields = _parse_head(head)
    n = _whole(fields, "content-length")
    if n is None or n < 0 or rest[n:] != b"\r\n\r\n":
        raise ValueError("length differs")
    return _checked(fields, rest[:n], head), at - len(z.unused_data)


def _plain(src: _Bytes, pos: int) -> tuple[dict, int]:
    """The uncompressed record at ``pos``, and where it ends."""
    n, head = 4096, b""
    while b"\r\n\r\n" not in head:
        if n > BLOCK or len(head) == src.size - pos:
            raise ValueError("no header")
        head = src.at(pos, min(n, src.size - pos))
        n *= 4
    head = head[: head.index(b"\r\n\r\n")]
    fields = _parse_head(head)
    size, at = _whole(fields, "content-length"), pos + len(head) + 4
    if size is None or size < 0 or at + size + 4 > src.size or src.at(at + size, 4) != b"\r\n\r\n":
        raise ValueError("length differs")
    return _checked(fields, src.at(at, size), head), at + size + 4


def salvage(handle, size: int) -> Iterator[tuple[str, int, int, object]]:
    """All sound records and all gaps of an archive, in file order:
    ("record", offset, length, fields and block) or ("gap", offset, length,
    the first reason)."""
    src, pos, gap, why = _Bytes(handle, size), 0, None, ""
    while pos < size:
        mark = src.at(pos, min(len(_VERSION), size - pos))
        try:
            if mark.startswith(_MAGIC):
                record, end = _member(src, pos)
            elif mark == _VERSION:
                record, end = _plain(src, pos)
            else:
                raise ValueError("no member or version line")
        except ValueError as e:
            if gap is None:
                gap, why = pos, str(e)[:80]
            pos = src.find(pos + 1)
            continue
        if gap is not None:
            yield "gap", gap, pos - gap, why
            gap = None
        yield "record", pos, end - pos, record
        pos = end
    if gap is not None:
        yield "gap", gap, size - gap, why


def _row(kind: str, at: int, length: int, what, path: str) -> tuple:
    if kind == "gap":
        return (*[None] * 7, path, at, length, what)
    return (what["page_id"], what["url"], what["payload"], what["payload_bytes"], what["digest"], what["kind"], what["refers_to"], path, at, length, None)


def read_archives(manifest: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of all archives of ``manifest`` (path, bytes, records): records with
    ``gap`` null, their url and, unless they are revisits, their payload; and
    quarantined gaps with their reason. ``strict``: an archive with a gap, or
    with other than the manifest's number of records, ends the job."""
    names = [f.split()[0] for f in ROW.split(", ")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                sound = 0
                with fs.open_input_file(name) as handle:
                    for found in salvage(handle, handle.size()):
                        sound += found[0] == "record"
                        if strict and found[0] == "gap":
                            raise ValueError(f"{path}: a gap of {found[2]} bytes at {found[1]}: {found[3]}")
                        rows.append(_row(*found, path))
                        held += len(rows[-1][2] or b"")
                        if len(rows) == 4096 or held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if strict and sound != records:
                    raise ValueError(f"{path}: {sound} records of {records}")
        if rows:
            yield batch(rows)

    files = manifest.select("path", "records").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return files.mapInArrow(run, ROW)


def _keys(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("html"))
        view = memoryview(data)
        shas = [hashlib.sha1(view[off[i]: off[i + 1]]).digest() for i in range(batch.num_rows)]
        ids = batch.column("page_id").to_pylist()
        keys = pa.array([s + (b"n" if i is None else b"%d" % i) for s, i in zip(shas, ids)], pa.binary())
        if keep:
            yield pa.record_batch([*batch.columns, keys], [*batch.schema.names, "_key"])
        else:
            yield pa.record_batch([batch.column("page_id"), keys, pa.array(shas, pa.binary())], ["page_id", "key", "sha"])


def _decisions(pages: DataFrame) -> DataFrame:
    """_key of every distinct (payload, page_id) and ``_top``, the largest
    page_id with that payload."""
    ids = pages.mapInArrow(lambda b: _keys(b, False), "page_id long, key binary, sha binary")
    ids = cut_lineage(ids.dropDuplicates(["key"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))))
    parts = ids.groupBy("sha", "salt").agg(F.max("page_id").alias("top"))
    tops = parts.groupBy("sha").agg(F.max("top").alias("_top"))
    verdict = parts.select("sha", "salt").join(tops, "sha")
    return ids.join(verdict, ["sha", "salt"]).select(F.col("key").alias("_key"), "_top")


def write_archives(pages: DataFrame, min_bytes: int = 0, base: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into archives
    under ``base`` (a fresh folder of the shared ones by default); returns the
    manifest: path, bytes, records."""
    base = base or shared_path(pages.sparkSession, "warc")
    base = base if re.match(r"\w+:", base) else "file://" + base
    base = re.sub(r"^file:/(?!/)", "file:///", base)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = pages.mapInArrow(lambda b: _keys(b, True), "page_id long, url string, html string, _key binary").join(_decisions(pages), "_key")
    copy = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    rows = rows.withColumn("first", (copy == 1) & F.col("page_id").eqNullSafe(F.col("_top"))).select("page_id", "url", "html", "_top", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(base)
        for batch in batches:
            for page_id, url, html, top, first in zip(*(batch.column(c) for c in range(5))):
                payload = (html.as_py() or "").encode()
                revisit = not first.as_py() and len(payload) >= min_bytes
                out.add(make_record(page_id.as_py(), url.as_py(), payload, base32_sha1(payload), top.as_py(), revisit))
        out.close()
        if out.done:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out.done), (pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return cut_lineage(rows.mapInArrow(run, MANIFEST))


def through_archives(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to of every record."""
    rows = read_archives(write_archives(pages, min_bytes), strict=True)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, CAST(unhex(h) AS BIT)::VARCHAR AS bits FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
         + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
