"""WARC archives as a PySpark Python data source.

``spark.read.format("warc").load(folder)`` plans one partition per group of archive files, takes
filters on the record type and on header columns, parses a record's headers first and decides by
them; the payload of a record that no filter keeps, or of any record when the schema asks for no
payload, is never decoded. Archives written here are gzipped record by record and carry each
record's compressed length in the gzip header ("sl" field), so an unwanted record is skipped by a
seek; other archives, plain or gzipped, are read through.

``df.write.format("warc")`` writes one series of files a task, each of at most ``max_file_bytes``
and one record. Files get names no other attempt uses, and count only once the job's commit lists
them in the manifest, so lost or repeated tasks leave nothing that is read. Paths may lie in any
store that pyarrow opens.

Defined results: a null payload is an empty one; a null URL leaves out the target header; control
characters and blanks in a URL are percent-encoded; an empty table gives an archive without
records; of rows with equal payloads of at least ``min_bytes``, those of the smallest id are
responses and the others revisits of it; rows with a null id are never referred to; extra columns stay out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack, unpack

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.llm.common import table
from colloquy.llm.registry import query
from colloquy.session import new_folder

SCHEMA = (
    "record_id string, warc_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, content_length long, payload_length long, payload binary"
)
#: Header of each header column.
HEADERS = {
    "record_id": "warc-record-id",
    "warc_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
MANIFEST = "_manifest.json"
#: Bytes of a file the writer closes, of a planned partition, and read for a record's headers.
FILE_BYTES, PARTITION_BYTES, HEAD_BYTES = 64 << 20, 64 << 20, 2048
DATE = "1970-01-01T00:00:00Z"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))


def base32_digest(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# --- writing


def record(row: dict) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    payload = row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    size = row["payload_length"] if revisit else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (size or 0)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"]))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {row['refers_to']}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(plain))
    return head + body + pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("max_file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None or size >= self.limit:
                        if out:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    member = record(row)
                    out.write(member)
                    size += len(member)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written]) -> None:
        system, root = opened(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{root}/{f}")


# --- reading


@dataclass
class Group(InputPartition):
    files: list[str]


def head_of(block: bytes) -> dict[str, str]:
    """Header lines by lower-cased name."""
    lines = block.split(b"\r\n")[1:]
    pairs = (x.partition(b":") for x in lines if b":" in x)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


class Record:
    """A record whose headers are parsed; ``block()`` decodes the rest."""

    def __init__(self, start: bytes, rest):
        self.head, _, self._start = start.partition(b"\r\n\r\n")
        self.headers = head_of(self.head)
        self._rest = rest
        self.length = int(self.headers.get("content-length", 0))

    def block(self, enough=None) -> bytes:
        """The block; with ``enough``, only until that text has come."""
        while len(self._start) < self.length and (enough is None or enough not in self._start):
            more = self._rest(self.length - len(self._start))
            if not more:
                raise ValueError("an archive ends inside a record")
            self._start += more
        return self._start[: self.length]


def records(f, size: int) -> Iterator[Record]:
    """Records of an open file, in order; what the caller doesn't decode is skipped."""
    at = 0
    while at < size:
        f.seek(at)
        first = f.read(HEAD_BYTES)
        if first[:2] == b"\x1f\x8b":
            known = unpack("<I", first[16:20])[0] if first[3] & 4 and first[12:14] == b"sl" else 0
            inflate = zlib.decompressobj(31)
            taken = [first[:known] if known else first]

            def rest(n, inflate=inflate, taken=taken):
                """Some more decoded bytes, about ``n`` at most, or none at the member's end."""
                while not inflate.eof:
                    data = inflate.unconsumed_tail or taken.pop() if taken or inflate.unconsumed_tail else f.read(1 << 16)
                    if not data:
                        return b""
                    if got := inflate.decompress(data, max(n, 64)):
                        return got
                return b""

            start = b""
            while b"\r\n\r\n" not in start and (more := rest(HEAD_BYTES)):
                start += more
            yield Record(start, rest)
            if known:
                at += known
            else:
                while rest(1 << 20):
                    pass
                at = f.tell() - len(inflate.unused_data)
        else:
            start = first.lstrip(b"\r\n")
            at += len(first) - len(start)
            if not start:
                continue
            while b"\r\n\r\n" not in start and (more := f.read(HEAD_BYTES)):
                start += more
            one = Record(start, lambda n: f.read(n))
            yield one
            at += len(one.head) + 4 + one.length + 4


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.verify = options.get("verify", "false").lower() == "true"
        self.target = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.filters.append(("in", name, {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.filters.append(("in", name, set(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.filters.append(("starts", name, f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.filters.append(("some", name, None))
            else:
                yield f

    def partitions(self) -> list[Group]:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            names = [x.path for x in found if re.search(r"\.warc(\.gz)?$", x.path)]
        else:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = [f"{root}/{n}" for n in json.loads(f.read())]
        groups, size = [], self.target
        for name in sorted(names):
            if size >= self.target:
                groups.append(Group([]))
                size = 0
            groups[-1].files.append(name)
            size += system.get_file_info(name).size
        return groups or [Group([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.filters:
            own = headers.get(HEADERS[name])
            if own is None or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        arrow, names = to_arrow_schema(self.schema), self.schema.names
        rows, held = [], 0
        for name in partition.files:
            with system.open_input_file(name) as f:
                for one in records(f, f.size()):
                    if not self.wanted(one.headers):
                        continue
                    row = self.row(one, names)
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def row(self, one: Record, names: list[str]) -> dict:
        row = {c: one.headers.get(HEADERS[c]) for c in names if c in HEADERS}
        row["content_length"] = one.length
        full = one.headers.get("warc-type") == "response" and (self.verify or "payload" in names)
        block = one.block(None if full else b"\r\n\r\n") if full or "payload_length" in names else b""
        http, _, payload = block.partition(b"\r\n\r\n")
        said = head_of(http).get("content-length")
        row["payload_length"] = len(payload) if full else int(said) if said else None
        if full and self.verify:
            digest = "sha1:" + base32_digest(hashlib.sha1(payload).digest())
            if digest != one.headers.get("warc-payload-digest"):
                raise ValueError(f"{one.headers.get('warc-record-id')}: the payload does not match its digest")
        if full and "payload" in names:
            row["payload"] = payload
        return {c: row.get(c) for c in names}


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(rows: DataFrame, row_id: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Records to write: one per row, equal payloads only once."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    base = rows.select(F.col(row_id).alias("id"), F.col(url).alias("target_uri"), body.alias("payload"))
    base = base.withColumns({"payload_length": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    same = base.filter(F.col("payload_length") >= min_bytes).groupBy("sha1").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    met = base.join(same.filter("n > 1 and first is not null").select("sha1", "first"), "sha1", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return met.select(
        record_id(F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        "target_uri",
        F.when(again, record_id(F.col("first").cast("string"))).alias("refers_to"),
        base32(F.col("sha1")).alias("payload_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_length",
    )


def record_id(of):
    return F.concat(F.lit("<urn:x-row:"), of, F.lit(">"))


def row_of(record):
    return F.nullif(F.regexp_extract(record, "^<urn:x-row:(.*)>$", 1), F.lit("null")).try_cast("long")


def base32(hex_digest):
    """Base32 of 20 bytes given in hexadecimal: 8 times 20 bits, 4 letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(hex_digest, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(letters), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, n, min(page_id) OVER (PARTITION BY h) AS first, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (5 * (k // 4) + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1, 1)
    FOR k IN range(32)], '') AS digest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


@query("op4_warc", _SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    path = new_folder(spark, "warc")
    with_revisits(table(spark, folder, "pages"), "page_id", "url", "html").write.format("warc").mode("append").save(path)
    narrow = T.StructType([f for f in T.StructType.fromDDL(SCHEMA) if f.name != "payload"])
    read = lambda: spark.read.format("warc").schema(narrow).option("verify", "true").load(path)
    both = read().filter(F.col("warc_type") == "response").unionByName(read().filter(F.col("warc_type") == "revisit"))
    return both.select(
        row_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        row_of(F.col("refers_to")).alias("refers_to"),
    )
