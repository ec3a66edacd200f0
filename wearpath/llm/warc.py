"""WARC archives: one gzip member a record, written by tasks and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearpath.llm.common import BATCH_ROWS, CHUNK_BYTES, map_batches, stored

#: Bytes of an archive that are one unit of reading, and units of a task in large reads.
RANGE_BYTES, RANGES_PER_TASK = 4 << 20, 16
#: Bytes after which a task begins another archive.
FILE_BYTES = 1 << 30
#: Bytes read from an archive at once, and the most that a record's header may have.
READ_BYTES, HEADER_BYTES = 256 << 10, 64 << 10

MAGIC = b"\x1f\x8b\x08"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_RECORDS = "path string, offset bigint, next bigint, kind string, record_id string, target string, date string, refers_to string, digest string, length bigint, payload binary, computed string"
_INDEX = "path string, size bigint, start bigint, floor bigint, entry bigint, exit bigint, records bigint"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; paths without a scheme are of the folders that all machines share."""
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if found else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str | None]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member. Headers without a value are left out; control characters in values become blanks."""
    lines = ["WARC/1.1", *(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', ' ', v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*lines, "", ""]).encode("utf-8", "replace")) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write_archives(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``records`` (record_id, kind, target, refers_to, sha1, length, payload) to archives; returns (path, size, records) of each.

    ``sha1`` is the hex digest of the whole payload and ``length`` its bytes. A revisit has
    no payload, but keeps both in its headers. A task's archives have names of their own,
    and only those of tasks that ended well are in the result, so repeated attempts add
    nothing. Null targets and references are left out. An empty table gives no archive.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    size, count = out.write(member(info, b"format: WARC File Format 1.1\r\n")) or 0, 0
                revisit = r["kind"] == "revisit"
                headers = [
                    ("WARC-Type", r["kind"]),
                    ("WARC-Record-ID", f"<{r['record_id']}>"),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", r["target"]),
                    ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["sha1"])).decode()),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                    ("WARC-Refers-To", f"<{r['refers_to']}>" if revisit else None),
                    ("Content-Type", "application/http;msgtype=response"),
                ]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['length']}\r\n\r\n"
                out.write(member(headers, http.encode() + (b"" if revisit else r["payload"])))
                count, size = count + 1, out.tell()
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "records"])

    return stored(map_batches(records, work, "path string, size bigint, records bigint"), "archives")


def archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size) of the archives that a path or pattern names, without empty files; their contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"))


class _Member:
    """The gzip member at ``at``, as far as it is a whole record; ``next`` is where it ends, or -1."""

    def __init__(self, file: pa.NativeFile, size: int, at: int, keep: bool):
        self.next, self.data, self.head = -1, b"", b""
        unpack, total, parts, pos = zlib.decompressobj(31), 0, [], at
        length = -1
        while not unpack.eof:
            raw = file.read_at(min(READ_BYTES, size - pos), pos) if pos < size else b""
            if not raw:
                return
            pos += len(raw)
            while raw and not unpack.eof:
                try:
                    piece = unpack.decompress(raw, 1 << 20)
                except zlib.error:
                    return
                raw = unpack.unconsumed_tail
                total += len(piece)
                if keep:
                    parts.append(piece)
                if length < 0:
                    self.head += piece
                    end = self.head.find(b"\r\n\r\n", 0, HEADER_BYTES)
                    if not self.head.startswith(b"WARC/"[: len(self.head)]) or end < 0 and len(self.head) >= HEADER_BYTES:
                        return
                    if end >= 0:
                        self.head = self.head[: end + 4]
                        found = _LENGTH.search(self.head)
                        if not found:
                            return
                        length = int(found[1])
        if length >= 0 and total == len(self.head) + length + 4:  # zlib has checked the member's sum and length
            self.next, self.data = pos - len(unpack.unused_data) - len(raw), b"".join(parts)


def members(file: pa.NativeFile, size: int, start: int, end: int, keep: bool = False) -> Iterator[tuple[int, _Member]]:
    """The records that start in [start, end), with their offsets: each place with gzip's magic bytes that decodes to a record.

    After a record the search goes on where it ends, which may lie beyond ``end``.
    """
    pos = start
    while pos < end:
        window = file.read_at(min(READ_BYTES, size - pos, end - pos + len(MAGIC) - 1), pos)
        at = window.find(MAGIC)
        if at < 0:
            pos += max(1, len(window) - len(MAGIC) + 1)
            continue
        found = _Member(file, size, pos + at, keep)
        if found.next < 0:
            pos += at + 1
        else:
            yield pos + at, found
            pos = found.next


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _bare(uri: str | None) -> str | None:
    return uri and uri.removeprefix("<").removesuffix(">")


def _parsed(path: str, offset: int, found: _Member) -> tuple:
    """A row of ``_RECORDS``."""
    h, block = _fields(found.head), memoryview(found.data)[len(found.head) : -4]
    kind, payload, length, computed = h.get("warc-type"), None, None, None
    if h.get("content-type", "").startswith("application/http"):
        text = bytes(block[:HEADER_BYTES])
        end = text.find(b"\r\n\r\n")
        if end >= 0:
            told = _LENGTH.search(text[: end + 4])
            length = int(told[1]) if told else None
            block = block[end + 4 :]
    if kind != "revisit":
        payload = bytes(block)
        length, computed = len(payload), digest_of(payload)
    digest = h.get("warc-payload-digest", "")
    return (
        path, offset, found.next, kind, _bare(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-date"), _bare(h.get("warc-refers-to")),
        digest.removeprefix("sha1:") or None, length, payload, computed,
    )


def _spread(ranges: DataFrame, ranges_per_task: int) -> DataFrame:
    n = ranges.count()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, max(2 * cores, math.ceil(n / ranges_per_task)))))


def _scanned(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """``_INDEX`` rows: for each range the first record from ``floor`` on and where the last one ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                store, path = store_of(r["path"])
                r |= {"entry": None, "exit": None, "records": 0}
                with store.open_input_file(path) as file:
                    for at, found in members(file, r["size"], max(r["start"], r["floor"]), min(r["size"], r["start"] + range_bytes)):
                        r["entry"] = at if r["entry"] is None else r["entry"]
                        r["exit"] = found.next
                        r["records"] += 1
            kinds = [pa.string(), *[pa.int64()] * 6]
            names = ["path", "size", "start", "floor", "entry", "exit", "records"]
            yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=names)

    return map_batches(ranges, work, _INDEX, rows=4)


def record_index(files: DataFrame, range_bytes: int = RANGE_BYTES, ranges_per_task: int = RANGES_PER_TASK) -> DataFrame:
    """Where the records of each byte range of ``files`` (path, size) begin: (path, size, start, floor, entry, exit, records).

    A range's task may take a record for its first that lies inside the payload of one that
    began in an earlier range (an archive within an archive). Such a range begins before
    the end of that record; it is scanned again from there, until no range does. The result
    is what one reader of the whole archive finds, whatever the range size.
    """
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    ranges = ranges.withColumn("floor", F.col("start"))
    index = stored(_scanned(_spread(ranges, ranges_per_task), range_bytes), "warc_index")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        marked = index.withColumn("least", F.greatest("start", F.max("exit").over(earlier)))
        stale = (F.col("floor") > F.col("least")) | F.coalesce(F.col("entry") < F.col("least"), F.lit(False))
        again = marked.where(stale).select("path", "size", "start", F.col("least").alias("floor"))
        if again.isEmpty():
            return index
        kept = marked.where(~stale).drop("least")
        index = stored(kept.unionByName(_scanned(_spread(again, ranges_per_task), range_bytes)), "warc_index")


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, ranges_per_task: int = RANGES_PER_TASK) -> DataFrame:
    """The records of ``files`` (path, size; see ``archives``), each read by the task whose byte range it starts in.

    Rows have path, offset, next (where the member ends), kind, record_id, target, date,
    refers_to, digest (the header's), length (bytes of the payload, of revisits as their
    HTTP header has it), payload and computed (the payload's own digest); the last two are
    null for revisits. Bytes that are no whole record (rubbish, damaged or cut members) are
    skipped. Empty files and an empty table give no rows.
    """
    own = record_index(files, range_bytes, ranges_per_task).where("entry is not null").select("path", "size", "start", "entry")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORDS.split(", ")]
        kinds = [pa.int64() if " bigint" in f else pa.binary() if " binary" in f else pa.string() for f in _RECORDS.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                store, path = store_of(r["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for at, found in members(file, r["size"], r["entry"], min(r["size"], r["start"] + range_bytes), keep=True):
                        rows.append(_parsed(r["path"], at, found))
                        held += len(found.data)
                        if held > CHUNK_BYTES or len(rows) >= BATCH_ROWS:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return map_batches(_spread(own, ranges_per_task), work, _RECORDS)


def _urn(id_column: Column) -> Column:
    return F.concat(F.lit("urn:wearpath:page:"), F.coalesce(id_column.cast("string"), F.lit("")))


def _page(urn: Column, kind: str) -> Column:
    return F.nullif(F.substring_index(urn, ":", -1), F.lit("")).cast(kind)


def page_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """The records of ``pages`` for ``write_archives``: of equal payloads that of the largest id is the response, others revisit it.

    Payloads of under ``least_bytes`` bytes are all responses. Null html is an empty payload. Rows that
    repeat the largest id are all responses; rows with a null id revisit if another id has the payload, else all are responses.
    Ids hold no colon. Payloads are compared by SHA-256 and length. Only payloads that occur twice or more are joined, as
    keys without text, and a hot one is split by adaptive execution.
    """
    payload = F.coalesce(F.col(html_column).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("target"), payload.alias("payload")).select(
        "*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("length"), F.sha2("payload", 256).alias("key")
    )
    groups = rows.where(F.col("length") >= least_bytes).groupBy("key", "length").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    keepers = stored(groups.where("n > 1 and keeper is not null").select("key", "length", "keeper"), "repeated_payloads")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    return rows.join(keepers, ["key", "length"], "left").select(
        _urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        "target",
        F.when(revisit, _urn(F.col("keeper"))).alias("refers_to"),
        "sha1",
        "length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``pages`` written to archives in ``folder`` and read back: (id_column, payload_bytes, payload_digest, record_type, refers_to).

    One row for each row of ``pages``, see ``page_records``; of responses the bytes and the
    digest are those of the payload that was read. An empty table gives no rows. Columns
    other than the three named are not read.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    files = write_archives(page_records(pages, id_column, url_column, html_column, least_bytes), folder)
    return (
        read_archives(files, range_bytes)
        .where("kind in ('response', 'revisit')")
        .select(
            _page(F.col("record_id"), kind).alias(id_column),
            F.col("length").alias("payload_bytes"),
            F.coalesce("computed", "digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            _page(F.col("refers_to"), kind).alias("refers_to"),
        )
    )


#: ``round_trip`` over ``pages`` in SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((strpos('0123456789abcdef', substr(hex, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, 2 + (5 * i) // 4, 1)) - 1)
      >> (3 - (5 * i) % 4)::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d
"""
