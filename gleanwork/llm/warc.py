"""WARC archives as a table of record chunks.

An archive is a table of (record_id, chunk_number, data, digest_so_far): a record's chunks in order
are its bytes in the WARC format. Chunk 0 is the record's header with the HTTP header, the others are
slices of the payload of at most ``chunk_bytes``, so no task holds a record beyond the row it
came in. Each chunk carries the SHA-1 of the payload up to its end; writers and readers advance one
digest by chunk, and a reader knows the first damaged one.

Which record is the response and which revisit it comes from narrow rows only: payload digests are
grouped, the smallest page_id of a group is its response, and only responses bring their payload.
Digests on a thousandth of the rows or more are broadcast, the others shuffled; where repeated
payloads are few, pages stay where they are. Spark writes the table, so a lost task leaves no half
record. ``export_files`` and ``file_chunks`` carry the table to .warc.gz files and back, in stores that
pyarrow can open.

Nulls and edge cases: a null html is an empty payload; a null page_id is the largest; of a
group's rows with equal page_id the smallest url comes first (null last); repeated rows get a record each,
the second and later ones as revisits of the first; a null url has no WARC-Target-URI, and
white space and control characters in a url are percent-escaped there; any length of payload is
written and read in chunks; an empty table gives an empty archive; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import join_by_frequency, materialize, narrow_result, release_memory

CHUNK = 1 << 20
#: Longest header that a reader gathers.
HEADER_LIMIT = 1 << 20
# Alphabets of base 32 and of Spark's conv; names of the WARC standard.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What can't stand in a header's line.
CONTROL = r"[\x00-\x20\x7F]"
EMPTY_DIGEST = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
CHUNKS = "record_id string, chunk_number int, data binary, digest_so_far string"
RECORDS = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, error string"


def base32(hexed: Column) -> Column:
    """Hexadecimal text of 40 digits in base 32: five of the former are four of the latter."""
    digits = [F.lpad(F.conv(F.substring(hexed, at, 5), 16, 32), 4, "0") for at in range(1, 40, 5)]
    return F.translate(F.concat(*digits), CONV32, BASE32)


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, data, payload_bytes and digest of each page."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", data.alias("data")).withColumn("hexed", F.sha1("data"))
    return rows.select("page_id", "url", "data", F.octet_length("data").cast("long").alias("payload_bytes"), base32(F.col("hexed")).alias("digest"))


def record_name(page_id: Column, url: Column, digest: Column, ordinal: Column) -> Column:
    """A record's URN: the page_id, 16 hex digits of url and payload, and which of equal rows it is."""
    of = F.substring(F.md5(F.concat_ws(" ", digest, url).cast("binary")), 1, 16)
    return F.concat_ws(":", F.lit("urn:page"), F.coalesce(page_id.cast("string"), F.lit("")), of, ordinal.cast("string"))


def page_of(record: Column) -> Column:
    return F.nullif(F.split_part(record, F.lit(":"), F.lit(3)), F.lit("")).cast("long")


def catalogue(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of all different (page_id, url, payload) with their number, and of each repeated payload its first row: tables on disk."""
    rows = payloads(pages).groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count("*").alias("n"))
    rows = materialize(rows)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "n")
    groups = rows.groupBy("digest").agg(F.sum("n").alias("copies"), F.min(order).alias("first")).where("copies > 1")
    return rows, materialize(groups)


def is_first(first: Column) -> Column:
    """Whether a row is the first of its payload; a payload that isn't repeated has no ``first``."""
    return first.isNull() | (F.col("page_id").eqNullSafe(first["page_id"]) & F.col("url").eqNullSafe(first["url"]))


def escaped(url: Column) -> Column:
    one = lambda c: F.when(c.rlike(CONTROL), F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")).otherwise(c)
    return F.when(url.rlike(CONTROL), F.concat_ws("", F.transform(F.split(url, ""), one))).otherwise(url)


def header_rows(rows: DataFrame, groups: DataFrame, total: int, date: str) -> DataFrame:
    """Chunk 0 of every record."""
    told = join_by_frequency(rows, groups, "digest", "copies", total, apart=F.col("page_id"))
    told = told.withColumn("ordinal", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    first = F.col("first")
    revisit = ~is_first(first) | (F.col("ordinal") > 0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    response_of = record_name(first["page_id"], first["url"], F.col("digest"), F.lit(0))
    content = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", escaped(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn(response_of)), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", content.cast("string")),
        F.lit("\r\n"),
        F.col("http"),
        F.when(F.col("revisit") | (F.col("payload_bytes") == 0), F.lit("\r\n\r\n")).otherwise(""),
    )
    named = told.withColumn("revisit", revisit).withColumn("http", http).withColumn("record_id", record_name(F.col("page_id"), F.col("url"), F.col("digest"), F.col("ordinal")))
    return named.select("record_id", F.lit(0).alias("chunk_number"), head.cast("binary").alias("data"), F.lit(EMPTY_DIGEST).alias("digest_so_far"))


def running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest so far to chunk rows (record_id, chunk_number, data, tail), which come in order; the last ``tail`` bytes aren't payload."""
    sha = hashlib.sha1()
    for batch in batches:
        told = []
        for number, data, tail in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            if number == 1:
                sha = hashlib.sha1()
            view = memoryview(data.as_buffer())
            sha.update(view[: len(view) - tail])
            told.append(b32(sha.digest()))
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(told, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["record_id", "chunk_number", "data", "digest_so_far"])
    release_memory()


def payload_rows(pages: DataFrame, groups: DataFrame, total: int, chunk_bytes: int) -> DataFrame:
    """Chunks 1, 2, ... of all responses."""
    joined = join_by_frequency(payloads(pages), groups, "digest", "copies", total, apart=F.col("page_id"))
    first = joined.where(is_first(F.col("first")) & (F.col("payload_bytes") > 0))
    if groups.where("first.n > 1").limit(1).count():  # equal rows: one of them brings the payload
        again = F.coalesce(F.col("first.n") > 1, F.lit(False))
        first = first.where(~again).unionByName(first.where(again).dropDuplicates(["digest"]))
    last = F.ceil(F.col("payload_bytes") / chunk_bytes).cast("int")
    name = record_name(F.col("page_id"), F.col("url"), F.col("digest"), F.lit(0))
    rows = first.select(name.alias("record_id"), "data", last.alias("last"), F.explode(F.sequence(F.lit(1), last)).alias("chunk_number"))
    ends = F.col("chunk_number") == F.col("last")
    data = F.substring(F.col("data"), (F.col("chunk_number") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    whole = F.when(ends, F.concat(data, F.lit(b"\r\n\r\n"))).otherwise(data)
    return rows.select("record_id", "chunk_number", whole.alias("data"), F.when(ends, 4).otherwise(0).alias("tail")).mapInArrow(running_digests, CHUNKS)


def record_chunks(pages: DataFrame, chunk_bytes: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """The archive of ``pages``: all chunks of one record per row. Nothing reads the clock; ``date`` is every record's."""
    rows, groups = catalogue(pages)
    total = rows.agg(F.sum("n")).first()[0] or 0
    return header_rows(rows, groups, total, date).unionByName(payload_rows(pages, groups, total, chunk_bytes))


class Reading:
    """One record, read chunk by chunk: headers are gathered, the payload is only counted and digested."""

    def __init__(self) -> None:
        self.head, self.fields, self.state, self.left = bytearray(), {}, "warc", 0
        self.http_length: int | None = None
        self.sha, self.length, self.error, self.tail = hashlib.sha1(), 0, None, 0

    def header(self, data: memoryview) -> memoryview | None:
        """Gather up to an empty line: what follows it, or None while it hasn't come."""
        begun = len(self.head)
        self.head += data[: HEADER_LIMIT + 4]
        at = self.head.find(b"\r\n\r\n", max(0, begun - 3))
        if at < 0:
            if len(self.head) > HEADER_LIMIT:
                raise ValueError(f"{self.state} header is longer than {HEADER_LIMIT} bytes")
            return None
        rest = data[at + 4 - begun :]
        self.head = self.head[:at]
        return rest

    def named_lines(self) -> dict[str, str]:
        _, *lines = self.head.decode("utf-8", "replace").split("\r\n")
        return {name.strip().lower(): value.strip(" \t") for name, _, value in (line.partition(":") for line in lines)}

    def feed(self, chunk: bytes | memoryview) -> None:
        data: memoryview | None = memoryview(chunk)
        while self.error is None and data is not None and len(data):
            if self.state == "warc":
                data = self.header(data)
                if data is not None:
                    if not self.head.startswith(b"WARC/1."):
                        raise ValueError("no WARC version line")
                    self.fields = self.named_lines()
                    self.left = int(self.fields.get("content-length", "-"))
                    self.head, self.state = bytearray(), "http" if self.fields.get("content-type", "").startswith("application/http") else "payload"
                    if self.state == "http" and not self.left:
                        self.state = "payload"
            elif self.state == "http":
                block, data = data[: self.left], data[self.left :]
                rest = self.header(block)
                self.left -= len(block)
                if rest is not None:
                    length = self.named_lines().get("content-length")
                    self.http_length = int(length) if length else None
                    self.state = "payload"
                    self.payload(rest)
                elif not self.left:
                    raise ValueError("HTTP header has no end")
            elif self.left:
                self.payload(data[: self.left])
                used = min(self.left, len(data))
                self.left -= used
                data = data[used:]
            else:
                if self.tail + len(data) > 4 or bytes(data) != b"\r\n\r\n"[self.tail : self.tail + len(data)]:
                    raise ValueError("bytes after the end of the record")
                self.tail += len(data)
                data = None

    def payload(self, data: memoryview) -> None:
        self.sha.update(data)
        self.length += len(data)

    def row(self, record_id: str) -> tuple:
        kind, error = self.fields.get("warc-type"), self.error
        stated = self.fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if error is None and (self.state != "payload" or self.left or self.tail != 4):
            error = "record ends early"
        length, digest = self.length, b32(self.sha.digest())
        if kind == "revisit":  # the full payload is the response's
            length, digest = self.http_length, stated
        elif error is None and stated is not None and stated != digest:
            error = "payload differs from its digest"
        trimmed = lambda v: v.removeprefix("<").removesuffix(">") if v else v
        return trimmed(self.fields.get("warc-record-id")) or record_id, kind, self.fields.get("warc-target-uri"), length, digest, trimmed(self.fields.get("warc-refers-to")), error


ARROW_RECORDS = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in (f.split()[0] for f in RECORDS.split(", "))])


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of chunk rows in order of record and chunk number; what can't be read is a row with an error."""
    current, reading, wanted, rows = None, Reading(), 0, []
    for batch in batches:
        for record_id, number, data, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            if record_id != current:
                if current is not None:
                    rows.append(reading.row(current))
                current, reading, wanted = record_id, Reading(), 0
            try:
                if reading.error is None and number != wanted:
                    raise ValueError(f"chunk {wanted} is missing")
                wanted += 1
                reading.feed(memoryview(data.as_buffer()))
                if reading.error is None and digest is not None and digest != b32(reading.sha.digest()):
                    raise ValueError(f"chunk {number} differs from its digest")
            except ValueError as e:
                reading.error = reading.error or str(e)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_RECORDS.types, strict=True)], schema=ARROW_RECORDS)
            rows = []
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(reading.row(current), ARROW_RECORDS.types, strict=True)], schema=ARROW_RECORDS)
    release_memory()


def read_records(chunks: DataFrame) -> DataFrame:
    """record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to and error of each record of an archive."""
    ordered = chunks.select("record_id", "chunk_number", "data", "digest_so_far").repartition("record_id").sortWithinPartitions("record_id", "chunk_number")
    return ordered.mapInArrow(parsed, RECORDS)


def export_files(chunks: DataFrame, folder: str, files: int) -> DataFrame:
    """Write an archive as ``files`` .warc.gz files, one gzip member per record: path, records and bytes of each.

    A file appears under its name only when it is whole, so a task may run twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = out = member = current = None
        records = size = 0
        ready = []

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            size += len(data)

        def close() -> None:
            put(member.flush())
            out.close()
            store.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            ready.append((f"{folder.rstrip('/')}/{name}", records, size))

        attempt = uuid.uuid4().hex
        for batch in batches:
            for file, record_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if name != f"archive-{file:05d}.warc.gz":
                    if out is not None:
                        close()
                    name, current, records, size = f"archive-{file:05d}.warc.gz", None, 0, 0
                    out = store.open_output_stream(f"{root}/{name}.{attempt}")
                    info = b"software: gleanwork\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{file}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    put(gzip.compress(head.encode() + info + b"\r\n\r\n", mtime=0))
                if record_id != current:
                    if current is not None:
                        put(member.flush())
                    member, current, records = zlib.compressobj(wbits=31), record_id, records + 1
                put(member.compress(memoryview(data.as_buffer())))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    file = F.pmod(F.xxhash64("record_id"), F.lit(files)).cast("int")
    ordered = chunks.select(file.alias("file"), "record_id", "data", "chunk_number").repartition(files, "file").sortWithinPartitions("file", "record_id", "chunk_number")
    return materialize(ordered.mapInArrow(write, "path string, records long, bytes long"))


def pieces_of(stream, piece: int) -> Iterator[bytes]:
    """A file's bytes in pieces, its gzip members unpacked."""
    head = stream.read(2)
    if head != b"\x1f\x8b":
        while head:
            yield head
            head = stream.read(piece)
        return
    member, data = zlib.decompressobj(wbits=31), head + stream.read(piece)
    while data:
        out = member.decompress(data, piece)
        if out:
            yield out
        if member.eof:
            data = member.unused_data or stream.read(piece)
            member = zlib.decompressobj(wbits=31)
        else:
            data = member.unconsumed_tail or stream.read(piece)


def cut_records(pieces: Iterator[bytes], chunk_bytes: int) -> Iterator[tuple[int, int, bytes]]:
    """(record, chunk number, data) of a WARC byte stream: chunk 0 is a header, then the block and what ends it in slices."""
    held, record = bytearray(), 0
    more = lambda: next(pieces, b"")
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and len(held) <= HEADER_LIMIT:
            data = more()
            if not data:
                break
            held += data
        if not held:
            return
        if end < 0:  # no header: the reader says so
            yield record, 0, bytes(held)
            return
        head, number = bytes(held[: end + 4]), 0
        del held[: end + 4]
        yield record, number, head
        length = [v for n, _, v in (line.partition(b":") for line in head.split(b"\r\n")) if n.strip().lower() == b"content-length"]
        left = int(length[0]) + 4 if length and length[0].strip().isdigit() else 0
        if not left:
            return
        while left:
            while len(held) < min(left, chunk_bytes) and (data := more()):
                held += data
            if not held:
                break
            number += 1
            part = bytes(held[: min(left, chunk_bytes)])
            del held[: len(part)]
            left -= len(part)
            yield record, number, part
        record += 1


def file_chunks(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk table of .warc and .warc.gz files, each streamed by one task; record_id is the file's path and the record's place in it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for record, number, data in cut_records(pieces_of(stream, chunk_bytes), chunk_bytes):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{path}#{record}"]), pa.array([number], pa.int32()), pa.array([data], pa.binary()), pa.array([None], pa.string())], names=["record_id", "chunk_number", "data", "digest_so_far"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
    return files.repartition("path").mapInArrow(read, CHUNKS)


@narrow_result
def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """What the archive of ``pages`` says when it is written and read again: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    records = read_records(materialize(record_chunks(pages, chunk_bytes), compression="zstd"))
    kind = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "record_id", "error"))).otherwise(F.col("record_type"))
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", kind.alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), "target_uri")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("target_uri")


OP11_SQL = """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages
), digested AS (
  SELECT page_id, url, octet_length(encode(payload)) AS payload_bytes,
         array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hexed, 5 * i + 1, 5) AS BIGINT) >> s) & 31) AS INTEGER), 1)), '')), '') AS payload_digest FROM payloads
), placed AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM digested
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to FROM placed
"""
