"""WARC archives of pages: a writer that stores equal payloads once, and a splittable reader.

Archives are files of gzip members, one for each record.  Spark's own text writer stores them, so they go to
any store that Spark can write to, and through its commit protocol: a lost task leaves nothing behind.  A row
of that writer is a run of members without its last byte, which is 0 (the top byte of a length below 2**24,
or that of an empty member after a longer one), and 0 is the writer's line separator.

The reader cuts files in byte ranges.  A task scans its range for the magic bytes of gzip, takes a place for a
member only if its header, decompressed, is that of a WARC record and the member is whole, and owns the records
that start inside its range, reading on beyond its end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.scratch import keep
from veilgrain.llm.text import small_batches

DATE = "2000-01-01T00:00:00Z"  # of every record, so that reruns write equal bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
READ_BYTES, PIECE_BYTES = 1 << 20, 16 << 10  # from the file, and into the decompressor, at a time
HEADER_BYTES = 64 << 10  # a record's WARC header must end within so many
BATCH_BYTES = 8 << 20
COPIES = 1 << 12  # equal rows that one row stands for while they are dealt out
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """One gzip member whose last byte is 0."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = deflate.compress(record) + deflate.flush()
    return out if out[-1] == 0 else out + _EMPTY


def record_id(*parts: object) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def header_value(value: str) -> str:
    """`value` in one line: control characters and blanks are escaped as in addresses."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, page: int | None, url: str | None, copy: int, payload: bytes | None, sha1: str, size: int, first: tuple[int | None, str | None] | None) -> bytes:
    """A response with its payload, or a revisit of `first`, the (page, url) of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = lambda p, u: header_value(u) if u else f"urn:page:{'none' if p is None else p}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page, url, sha1, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target(page, url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id('response', *first, sha1, 0)}", f"WARC-Refers-To-Target-URI: {target(*first)}", f"WARC-Refers-To-Date: {DATE}"]
        if first[0] is not None:
            lines.append(f"X-Refers-To-Page: {first[0]}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of members without the last byte; `first` is null in responses, which have the payload."""
    for batch in small_batches(batches):
        out = []
        for r in batch.to_pylist():
            payload, first = r["payload"], r["first"]
            kind = "response" if first is None else "revisit"
            sha1 = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
            out.append(member(record(kind, r["page_id"], r["url"], r["copy"], payload, sha1, r["size"], first and (first["page_id"], first["url"])))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(pages: DataFrame, path: str) -> None:
    """Archives of `pages` (page_id long, url string, html string; other columns are ignored) in the folder
    `path`, a record for each row, its payload the html in UTF-8 (null: empty).

    Of equal payloads that with the smallest page_id (a null one last, then the smaller url) is a response,
    the others are revisits.  Payloads meet as one row for each task, and rows without them, so a payload
    that many pages share is no load for one task.  Equal rows are a record each."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    # The least row of each payload, and the payload itself, combined in the tasks that read it.
    whole = rows.groupBy("key", "sha1", "size").agg(F.min(place).alias("least"), F.first("payload").alias("payload"))
    response = whole.select("least.page_id", "least.url", F.lit(0).cast("long").alias("copy"), "payload", "sha1", "size", F.lit(None).cast("struct<page_id: long, url: string>").alias("first"))

    # The narrow rows: how many are alike, and the first of their payload.
    alike = keep(rows.groupBy("key", "page_id", "url", "sha1", "size").agg(F.count("*").alias("n")))
    firsts = alike.groupBy("key").agg(F.min(place).alias("least"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    again = alike.join(firsts, "key").withColumn("copies", F.col("n") - F.when(F.col("least").eqNullSafe(place), 1).otherwise(0)).where("copies > 0")
    again = again.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition(F.xxhash64("key", "page_id", "url", "part"))
    again = again.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least((F.col("part") + 1) * COPIES, F.col("copies")))))
    revisit = again.select("page_id", "url", "copy", F.lit(None).cast("binary").alias("payload"), "sha1", "size", F.struct("least.page_id", "least.url").alias("first"))
    for part, name in ((response, "responses"), (revisit, "revisits")):
        made = part.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
        made.write.option("lineSep", "\0").text(f"{path}/{name}")


def _opened(path: str) -> BinaryIO:
    """A file of Hadoop's kind of path, for reading at any place."""
    if (m := re.match(r"file:/+(.*)", path)) or path.startswith("/"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + (m[1] if m else path.lstrip("/")))
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _headers(block: bytes) -> dict[str, str]:
    """Names in lower case; the first line, under the empty name."""
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    return {"": first} | {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in rest if line)}


class _Window:
    """Bytes of a file from any place, read READ_BYTES at a time."""

    def __init__(self, file: BinaryIO):
        self.file, self.start, self.data = file, 0, b""

    def _hold(self, at: int, least: int) -> int:
        """Has `least` bytes from `at` on at hand, if the file does; where they begin in `data`."""
        if at < self.start or self.start + len(self.data) < at + least:
            self.file.seek(at)
            self.start, self.data = at, self.file.read(READ_BYTES)
        return at - self.start

    def piece(self, at: int) -> bytes:
        """Some bytes from `at` on; none at the end of the file."""
        begin = self._hold(at, 1)
        return self.data[begin : begin + PIECE_BYTES]

    def magic(self, at: int) -> int | None:
        """Where the next magic bytes from `at` on begin."""
        while True:
            begin = self._hold(at, len(MAGIC))
            if (found := self.data.find(MAGIC, begin)) >= 0:
                return self.start + found
            if len(self.data) - begin < len(MAGIC):
                return None
            at = self.start + len(self.data) - len(MAGIC) + 1


def _unpacked(window: _Window, start: int) -> tuple[bytes, int] | None:
    """(record, end) of the member that begins at `start`, or None if it isn't a whole member of a WARC record."""
    inflate, out, at, known = zlib.decompressobj(31), [], start, False
    try:
        while not inflate.eof:
            if not (data := inflate.unconsumed_tail):
                if not (data := window.piece(at)):
                    return None  # the file ends inside
                at += len(data)
            out.append(inflate.decompress(data, 0 if known else HEADER_BYTES))
            if not known:
                head = b"".join(out)
                known = head.startswith(b"WARC/") and b"\r\n\r\n" in head
                if not known and (head[:5] != b"WARC/"[: len(head)] or len(head) >= HEADER_BYTES or inflate.eof):
                    return None
    except zlib.error:
        return None
    return b"".join(out), at - len(inflate.unused_data)


def records_of_range(file: BinaryIO, start: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the members that start in [start, stop)."""
    window, at = _Window(file), start
    while (begin := window.magic(at)) is not None and begin < stop:
        if (whole := _unpacked(window, begin)) is None:
            at = begin + 1
        else:
            at = whole[1]
            yield begin, at - begin, whole[0]


FOUND = "path string, offset long, length long, type string, headers map<string,string>, http map<string,string>, payload binary"


def parsed(found: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; a block that isn't HTTP is all payload."""
    head, _, rest = found.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers.get("content-length", len(rest)))]
    if "application/http" not in headers.get("content-type", ""):
        return headers, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, _headers(http), payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), kind, kind, pa.binary()]
    names = ["path", "offset", "length", "type", "headers", "http", "payload"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    for batch in batches:
        for r in batch.to_pylist():
            held, size = [], 0
            with _opened(r["path"]) as file:
                for offset, length, found in records_of_range(file, r["start"], r["stop"]):
                    headers, http, payload = parsed(found)
                    held.append((r["path"], offset, length, headers.get("warc-type"), list(headers.items()), list(http.items()), payload))
                    size += len(found)
                    if size >= BATCH_BYTES:
                        yield packed(held)
                        held, size = [], 0
            if held:
                yield packed(held)


def read(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, length, type, headers, http, payload): the records of the gzip-compressed archives in
    `paths`, folders or files, a task for each range of bytes.

    Spark lists the files; tasks read their ranges through Arrow's file systems (local, HDFS, S3 and others).
    Bytes between members, members of other things than WARC records, and a member that breaks off are passed
    over.  A record whose payload holds a whole compressed archive that deflate could only store is the one
    thing that a range which begins inside it would take for records of its own.  Empty files give no rows."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"))
    return ranges.repartition(F.xxhash64("path", "start")).mapInArrow(_read, FOUND)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(dict(h), dict(p), t, b) for h, p, t, b in zip(*[batch.column(c).to_pylist() for c in ("headers", "http", "type", "payload")], strict=True)]
        number = lambda v: None if v is None else int(v)
        response = [t == "response" for _, _, t, _ in rows]
        columns = [
            pa.array([number(h.get("x-page-id")) for h, *_ in rows], pa.int64()),
            pa.array([len(b) if own else int(p["content-length"]) for own, (_, p, _, b) in zip(response, rows, strict=True)], pa.int64()),
            pa.array([digest(b) if own else h["warc-payload-digest"].removeprefix("sha1:") for own, (h, _, _, b) in zip(response, rows, strict=True)], pa.string()),
            batch.column("type"),
            pa.array([number(h.get("x-refers-to-page")) for h, *_ in rows], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def summary(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that `write` wrote.  A
    response's size and digest are taken from the payload that was read, a revisit's from its headers, since
    its payload isn't stored again.  refers_to is null for responses, and where the response has no page_id."""
    return records.mapInArrow(_summed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
