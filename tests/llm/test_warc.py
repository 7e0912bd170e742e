import gzip
import io
import random

import pytest

from scorelake.llm import warc as W


def records(n, rng):
    out = []
    for i in range(n):
        payload = bytes(rng.choice([rng.randbytes(rng.randint(0, 400)), b"WARC/1.1 \x1f\x8b\x08 decoy \r\n\r\n" * rng.randint(0, 3), b"x" * rng.randint(0, 5000)]))
        out.append(W.make_record(i, f"http://h/{i} \r\n", payload, W.base32_sha1(payload), None, False))
    return out


def read(raw):
    return list(W.salvage(io.BytesIO(raw), len(raw)))


@pytest.mark.parametrize("plain", [False, True])
def test_clean_archives(plain):
    parts = records(40, random.Random(1))
    got = read(b"".join(parts if plain else map(gzip.compress, parts)))
    assert [g[0] for g in got] == ["record"] * 40
    assert [int(g[3]["fields"]["warc-page-id"]) for g in got] == list(range(40))


@pytest.mark.parametrize("seed", range(30))
def test_damage_costs_only_damaged_records(seed):
    rng = random.Random(seed)
    parts = [p if rng.random() < 0.4 else gzip.compress(p) for p in records(30, rng)]
    hurt = set(rng.sample(range(30), 5))
    raw, ends = b"", []
    for i, p in enumerate(parts):
        if i in hurt:
            how = rng.randrange(3)
            at = rng.randrange(len(p))
            p = p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1:] if how == 0 else p[:at] if how == 1 else rng.randbytes(50) + p[60:]
        raw += p
        ends.append(len(raw))
    got = read(raw)
    ids = [int(g[3]["fields"]["warc-page-id"]) for g in got if g[0] == "record" and g[3]["fields"].get("warc-page-id", "").isdigit()]
    assert set(range(30)) - hurt <= set(ids)
    assert sum(g[2] for g in got) == len(raw) and [g[1] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]  # no byte is unaccounted for
    assert any(g[0] == "gap" for g in got)


def test_empty_and_garbage():
    assert read(b"") == []
    assert [g[:3] for g in read(b"\x00" * 3_000_000)] == [("gap", 0, 3_000_000)]


def test_every_header_byte_altered():
    parts = [W.make_record(i, f"http://h/{i}", b"payload %d" % i, W.base32_sha1(b"payload %d" % i), 7, i == 1) for i in range(3)]
    sound = read(b"".join(parts))
    for at in range(len(parts[1])):
        for flip in (0x01, 0x55, 0x80):
            hurt = bytearray(parts[1])
            hurt[at] ^= flip
            raw = parts[0] + bytes(hurt) + parts[2]
            rows = [W._row(*found, "p") for found in read(raw)]
            ids = [r[0] for r in rows if r[-1] is None]
            assert ids[0] == 0 and ids[-1] == 2 and sum(r[-2] for r in rows) == len(raw)
            if len(ids) == 3:  # what the digests don't cover: letter case of their own line's name, white space
                assert rows[1][:7] == W._row(*sound[1], "p")[:7], (at, flip)


def test_fields_that_are_no_numbers_are_gaps():
    good = W.make_record(5, None, b"x", W.base32_sha1(b"x"), None, False)
    for old, new in ((b"WARC-Page-ID: 5", b"WARC-Page-ID: 5x"), (b"Content-Length: 1", b"Content-Length: one"), (b"WARC-Page-ID: 5", b"WARC-Page-ID: 99999999999999999999")):
        lines = [x for x in good.split(b"\r\n") if not x.startswith(b"WARC-Header-Digest")]
        got = read(b"\r\n".join(lines).replace(old, new) + good)
        assert [g[0] for g in got] == ["gap", "record"]


SCHEMA = "page_id long, url string, html string, path string, gap int"


def test_round_trip_edges(spark):
    rows = [(1, "u", None, "", 0), (2, None, "", None, 1), (3, "u\n", "é" * 10, "", 0), (9, "v", "é" * 10, "", 0), (9, "v", "é" * 10, "", 0),
            (None, "w", "only", "", 0), (None, "w", "hot", "", 0), (5, "big", "b" * 3_000_000, "", 0)] + [(100 + i, "h", "hot", "", 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = W.through_archives(spark, df).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r.page_id and W.base32_sha1((x[2] or "").encode()) == r.payload_digest]
        assert mine and r.payload_bytes == len((mine[0][2] or "").encode())
        same = [x[0] for x in rows if (x[2] or "") == (mine[0][2] or "")]
        top = max((i for i in same if i is not None), default=None)
        assert r.refers_to == (top if r.record_type == "revisit" else None) and (r.record_type == "response" or len(same) > 1)
        assert r.record_type == "revisit" or r.page_id == top
    assert sum(r.record_type == "response" for r in got) == 5
    small = W.through_archives(spark, df, min_bytes=4).collect()
    assert sum(r.record_type == "response" for r in small) == 2 + 101 + 3
    assert W.through_archives(spark, df.limit(0)).count() == 0


def test_gaps_are_logged_and_later_records_read(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50, "", 0) for i in range(30)], SCHEMA).coalesce(1)
    files = W.write_archives(df, base=f"file://{tmp_path}")
    first = files.collect()[0]
    name = first.path.removeprefix("file://")
    raw = open(name, "rb").read()
    open(name, "wb").write(raw[:40] + b"\xff" * 10 + raw[50:])
    rows = W.read_archives(files).collect()
    gaps = [r for r in rows if r.gap is not None]
    assert len(gaps) == 1 and gaps[0].at == 0 and gaps[0].path == first.path
    assert len(rows) - 1 == 29


def test_payload_and_url_come_back_and_losses_are_seen(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "é" * i, "", 0) for i in range(20)] + [(50, "http://h/50", "é" * 7, "", 0)], SCHEMA).coalesce(1)
    files = W.write_archives(df, base=f"file://{tmp_path}")
    got = {r.page_id: r for r in W.read_archives(files, strict=True).collect()}
    assert len(got) == 21 and all(got[i].url == f"http://h/{i}" for i in got)
    assert all(bytes(r.payload).decode() == "é" * i for i, r in got.items() if r.record_type == "response" and i != 50)
    assert got[7].record_type == "revisit" and got[7].payload is None and got[7].refers_to == 50 and bytes(got[50].payload).decode() == "é" * 7
    short = files.withColumn("records", W.F.col("records") + 1)
    with pytest.raises(Exception, match="records of"):
        W.read_archives(short, strict=True).collect()
    name = files.first().path.removeprefix("file://")
    raw = open(name, "rb").read()
    open(name, "wb").write(raw[:60] + b"\xff" + raw[61:])
    with pytest.raises(Exception, match="a gap of"):
        W.read_archives(files, strict=True).collect()
