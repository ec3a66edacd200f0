"""Archives written by tasks and read by byte ranges, against gzip members read one after the other."""

import gzip
import hashlib
import os
import random
import zlib

import pytest

from wearpath.llm import warc

PAGES = "page_id bigint, url string, html string, id int, kind string, payload int, key string, keeper string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, f"http://x.org/{i}\r\nWARC-Type: y", h, 1, "k", 2, "k", "z") for i, h in rows], PAGES).repartition(3)


def record(payload, ident="urn:x:1", level=6):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return warc.member([("WARC-Type", "response"), ("WARC-Record-ID", f"<{ident}>"), ("Content-Type", "application/http; msgtype=response")], http + payload, level)


def sequential(data):
    """(offset, payload) of all records, as one reader from the front finds them."""
    out, pos = [], 0
    while (pos := data.find(b"\x1f\x8b\x08", pos)) >= 0:
        unpack = zlib.decompressobj(31)
        try:
            text = unpack.decompress(data[pos:])
        except zlib.error:
            text = b""
        if unpack.eof and text.startswith(b"WARC/"):
            out.append((pos, text.split(b"\r\n\r\n", 2)[-1][:-4]))
            pos = len(data) - len(unpack.unused_data)
        else:
            pos += 1
    return out


def archive(kind, rng):
    if kind == "nested":  # archives stored without compression inside records: their members decode as records too
        inner = b"".join(record(rng.randbytes(rng.randrange(2000)), level=0) for _ in range(40))
        parts = [record(inner, level=0), record(b"between"), record(record(inner[:9000] + b"x", level=0), level=0), record(b"", level=0)]
        return b"".join(parts * 3)
    if kind == "damaged":
        parts = [record(rng.randbytes(rng.randrange(3000))) for _ in range(30)]
        parts[3] = b"rubbish \x1f\x8b\x08 and more" + gzip.compress(b"no record")
        parts[7] = parts[7][:-5]
        parts[9] = parts[9][:40] + b"\0" * 9 + parts[9][49:]
        return b"".join(parts) + record(b"cut off")[:-3]
    return b"".join(record(rng.randbytes(rng.choice([0, 10, 50_000]))) for _ in range(25))


@pytest.mark.parametrize("kind", ["plain", "nested", "damaged"])
@pytest.mark.parametrize("range_bytes", [700, 5000, 1 << 22])
def test_ranges_read_what_one_reader_reads(spark, tmp_path, kind, range_bytes):
    data = [archive(kind, random.Random(i)) for i in range(2)] + [b""]
    for i, d in enumerate(data):
        (tmp_path / f"{i}.warc.gz").write_bytes(d)
    files = warc.archives(spark, f"{tmp_path}/*.warc.gz")
    assert sorted(r["size"] for r in files.collect()) == sorted(len(d) for d in data if d)
    found = warc.read_archives(files, range_bytes, ranges_per_task=50).collect()
    for i, d in enumerate(data):
        own = sorted((r["offset"], bytes(r["payload"]), r["next"]) for r in found if r["path"].endswith(f"/{i}.warc.gz"))
        assert [r[:2] for r in own] == sequential(d)
        assert all(a[2] <= b[0] for a, b in zip(own, own[1:]))
    assert all(r["computed"] == warc.digest_of(bytes(r["payload"])) for r in found)


def test_round_trip_by_hand(spark, tmp_path):
    big = "".join(random.Random(1).choices("abcé漢", k=300_000))
    rows = [(0, "a"), (1, "b"), (2, "a"), (3, ""), (4, None), (5, big), (6, big), (7, "c"), (7, "c"), (8, "c\r\n\r\n"), (None, "b"), (None, "n"), (None, "n"), (9, "WARC/1.1\r\n\r\n")]
    out = warc.round_trip(pages_of(spark, rows), os.fspath(tmp_path / "w"), range_bytes=20_000)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = []
    for i, h in rows:
        same = [j for j, g in rows if (g or "") == (h or "") and j is not None]
        revisit = bool(same) and i != max(same)
        data = (h or "").encode()
        want.append((i, len(data), warc.digest_of(data), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_small_payloads_are_never_revisits(spark, tmp_path):
    out = warc.round_trip(pages_of(spark, [(0, "ab"), (1, "ab"), (2, "abc"), (3, "abc")]), os.fspath(tmp_path / "w"), least_bytes=3)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in out.collect()) == [(0, "response", None), (1, "response", None), (2, "revisit", 3), (3, "response", None)]


def test_archives_are_gzip_files_of_whole_records(spark, tmp_path):
    folder = os.fspath(tmp_path / "w")
    records = warc.page_records(pages_of(spark, [(i, f"text {i % 40}") for i in range(60)]))
    files = warc.write_archives(records, folder, file_bytes=2000).collect()
    assert sum(f["records"] for f in files) == 60 and len(files) > 3
    for f in files:
        data = open(f["path"].removeprefix("file:"), "rb").read()
        assert len(data) == f["size"] and len(sequential(data)) == f["records"] + 1
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"WARC-Type: y" not in text.replace(b" WARC-Type: y", b"")


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(pages_of(spark, [(1, "a")]).where("false"), os.fspath(tmp_path / "w")).count() == 0
