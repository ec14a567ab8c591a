"""WARC archives as a Python data source.

Writing: ``df.write.format("warc")`` makes one archive file a task (a new one after
``max_file_bytes`` of payload), each record a gzip member whose header holds its compressed
and uncompressed length in an extra field ``sl``.  A task writes under a name of its own attempt, and
only the files of successful attempts are listed in the manifest that commits the archive.

Reading: ``spark.read.format("warc")`` packs the files into partitions of about
``split_bytes``.  Filters on record type, ids and other headers are pushed down: the
header of a record is inflated first, and if it is not wanted, the rest of the member is
skipped by its length, without decoding.  A schema without ``payload`` never decodes any.

Defined cases: NULL payloads are empty; NULL header values are left out and read as NULL;
control characters and per cent signs in header values are percent-encoded and read back as
they were; repeated records are records each; an empty table gives an archive without
records; members of other writers without the extra field are inflated to be skipped.
"""

from __future__ import annotations

import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, WriterCommitMessage)

from shoreline.llm.common import ship

#: column and header of a record's fields, fixed by the format; the last three are extensions
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Length",
}
SCHEMA = T.StructType([*[T.StructField(c, T.LongType() if c == "payload_bytes" else T.StringType()) for c in HEADERS],
                       T.StructField("payload", T.BinaryType())])
MANIFEST = "_manifest"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    """File system and path; any store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _quote(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def encode(row: dict) -> bytes:
    """One gzip member for a record."""
    payload = bytes(row.get("payload") or b"")
    revisit = row.get("record_type") == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines = ["WARC/1.1"]
    lines += [f"{h}: {_quote(str(row[c]))}" for c, h in HEADERS.items() if row.get(c) is not None]
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    total = 12 + 12 + len(body) + 8  # head, extra field, data, trailer
    if max(total, len(raw)) >> 32:  # too long for the extra field
        head = struct.pack("<4BIBB", 31, 139, 8, 0, 0, 0, 255)
    else:
        head = struct.pack("<4BIBB", 31, 139, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, total, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], max_file_bytes: int):
        self.path, self.columns, self.max_file_bytes = path, columns, max_file_bytes

    def write(self, rows: Iterator) -> Files:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for row in rows:
            if out is None or size >= self.max_file_bytes:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
            record = dict(zip(self.columns, row))
            size += len(record.get("payload") or b"")
            out.write(encode(record))
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write("\n".join(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Files | None]) -> None:
        fs, root = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{name}")


@dataclass
class Split(InputPartition):
    files: tuple[str, ...]


def _extra_length(head: bytes) -> int | None:
    """Compressed length of the member from its extra field."""
    if len(head) >= 24 and head[3] & 4:
        (n,) = struct.unpack_from("<H", head, 10)
        at = 12
        while at + 4 <= min(12 + n, len(head)):
            name, size = struct.unpack_from("<2sH", head, at)
            if name == b"sl" and size >= 8 and at + 8 <= len(head):
                return struct.unpack_from("<I", head, at + 4)[0]
            at += 4 + size
    return None


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def records(stream, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and payload if asked, of the records that ``wanted`` accepts by their headers."""
    at, end = 0, stream.size()
    while at < end:
        stream.seek(at)
        data = stream.read(4096)
        length = _extra_length(data)
        unpack = zlib.decompressobj(31)
        raw, fed = b"", len(data)
        raw += unpack.decompress(data, 4096)
        while b"\r\n\r\n" not in raw and not unpack.eof:
            more = unpack.unconsumed_tail
            if not more:
                more = stream.read(65536)
                fed += len(more)
                if not more:
                    raise ValueError(f"record at {at} ends early")
            raw += unpack.decompress(more, 4096)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = _headers(head)
        take = wanted(fields)
        if (not take or not payload) and length:
            if take:
                yield fields, None
            at += length
            continue
        parts = [rest]
        while not unpack.eof:
            more = unpack.unconsumed_tail
            if not more:
                more = stream.read(65536)
                fed += len(more)
                if not more:
                    raise ValueError(f"record at {at} ends early")
            part = unpack.decompress(more, 1 << 20)
            if take and payload:
                parts.append(part)
        if take:
            body = None
            if payload:
                block = b"".join(parts)[:int(fields.get("content-length", 0))]
                body = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
            yield fields, body
        at += fed - len(unpack.unused_data)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes = path, schema, split_bytes
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, frozenset([str(f.value)])))
            elif isinstance(f, In):
                self.tests.append((column, frozenset(map(str, f.value))))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self) -> Sequence[Split]:
        fs, root = _filesystem(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            names = [n for n in f.read().decode().split("\n") if n]
        infos = fs.get_file_info([f"{root}/{n}" for n in names])
        out, files, size = [], [], 0
        for info in sorted(infos, key=lambda i: (-i.size, i.path)):
            if files and size + info.size > self.split_bytes:
                out.append(Split(tuple(files)))
                files, size = [], 0
            files.append(info.path)
            size += info.size
        return [*out, Split(tuple(files))]

    def read(self, partition: Split) -> Iterator[tuple]:
        fs, _ = _filesystem(self.path)
        names = [f.name for f in self.schema.fields]

        def value(fields: dict[str, str], column: str):
            v = fields.get(HEADERS[column].lower())
            if v is None:
                return None
            return int(v) if column == "payload_bytes" else urllib.parse.unquote(v)

        def wanted(fields: dict[str, str]) -> bool:
            for column, allowed in self.tests:
                v = value(fields, column)
                if v is None or allowed is not None and str(v) not in allowed:
                    return False
            return True

        for path in partition.files:
            with fs.open_input_file(path) as stream:
                for fields, payload in records(stream, wanted, "payload" in names):
                    yield tuple(payload if n == "payload" else value(fields, n) for n in names)


class WarcSource(DataSource):
    """Options: ``path``; ``max_file_bytes`` and ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", 32 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], [f.name for f in schema.fields], int(self.options.get("max_file_bytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The archive's records; without ``payload`` among the columns none is decoded."""
    register(spark)
    chosen = T.StructType([f for f in SCHEMA.fields if columns is None or f.name in columns])
    return spark.read.format("warc").schema(chosen).option("path", path).load()


def write(records_: DataFrame, path: str) -> None:
    register(records_.sparkSession)
    records_.write.format("warc").mode("append").option("path", path).save()


def page_records(pages: DataFrame, min_payload: int = 100) -> DataFrame:
    """Records of ``pages (page_id, url, html)``: of equal payloads of at least ``min_payload``
    bytes, the one of smallest ``page_id`` is the response, and others revisit it.

    Rows that repeat the smallest id are responses each; rows without an id revisit the others, and are
    all responses where no equal payload has an id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    digest = F.sha2(payload, 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
                        payload.alias("payload"), digest.alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = (rows.filter(F.col("payload_bytes") >= min_payload).groupBy("digest").agg(
        F.min("page_id").alias("original"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("digest", "original"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(first, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), "target_uri", F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn("original")).alias("refers_to"), "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"))


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` from an archive of pages:
    responses by their decoded payloads, revisits by their headers alone."""
    page = lambda c: F.regexp_extract(F.col(c), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    headers = ["record_type", "record_id", "payload_digest", "refers_to", "payload_bytes"]
    full = read(spark, path, ["record_type", "record_id", "payload"]).filter(F.col("record_type") == "response").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read(spark, path, headers).filter(F.col("record_type") == "revisit").select(
        page("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))
    return full.unionByName(again)
