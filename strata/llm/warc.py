"""WARC archives as a PySpark Python data source.

Reading plans one partition per run of files of about ``partition_bytes``. Of a record the
headers are parsed first. Predicates on the record type and the header columns are pushed
down and decided on the headers alone; the payload of a record that fails them, or of any
record with the option ``payload=false``, is not decoded: in plain files and in members whose
gzip header names their length it is not even read.

Writing gives every record a gzip member of its own, named with its length, in files that
are rolled at ``file_bytes``. A task's files get fresh names; the driver lists those of the
attempts that succeeded in a ``_manifest-*.json`` of that write, and where there are such lists
only their files are read, so a lost or repeated attempt leaves no record twice and a later
append hides no earlier one.

Files are reached through ``pyarrow.fs``, so paths may name any store that it knows.

Defined results: a null payload is empty; a null header is left out and reads back as null;
line breaks and per cent signs in header values are escaped and read back; an empty table
gives an archive without records; columns beyond those of :data:`SCHEMA` are not written.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

NAME = "strata_warc"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)
_HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Length",
}
_ARROW = pa.schema([(n, pa.string()) for n in list(_HEADERS)[:-1]] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
PARTITION_BYTES, FILE_BYTES = 64 << 20, 256 << 20
MIN_SHARED = 100
_GZIP_HEAD = struct.Struct("<2sBBIBB")
_SKIP = struct.Struct("<H2sHII")  # extra length, "sl", 8, compressed and plain length
_PEEK, _ROWS = 1 << 12, 1 << 24


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"\w+://", path) and not path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def _quote(value: str) -> str:
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def _unquote(value: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), value)


def encode(record: dict) -> bytes:
    """A record as one gzip member that names its own length."""
    payload = record.get("payload") or b""
    lines = ["WARC/1.1"]
    for column, header in _HEADERS.items():
        if record.get(column) is not None:
            lines.append(f"{header}: {_quote(str(record[column]))}")
    lines.append(f"Content-Length: {len(payload)}")
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(plain) + deflate.flush()
    head = _GZIP_HEAD.pack(b"\x1f\x8b", 8, 4, 0, 0, 255) + _SKIP.pack(12, b"sl", 8, len(body), len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    """Header values by lower-case name."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {name.strip().lower(): _unquote(value.strip()) for name, _, value in pairs}


class _Wanted:
    """Decides on headers alone whether a record and its payload are wanted."""

    def __init__(self, filters: list[Filter], payload: bool):
        self.filters, self.payload = filters, payload

    def row(self, headers: dict[str, str]) -> dict | None:
        row: dict = {column: headers.get(name.lower()) for column, name in _HEADERS.items()}
        own = row["payload_bytes"] if row["payload_bytes"] is not None else headers.get("content-length", 0)
        row["payload_bytes"] = int(own)
        for f in self.filters:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                fits = value is None
            elif isinstance(f, IsNotNull):
                fits = value is not None
            elif isinstance(f, In):
                fits = value is not None and value in f.value
            elif isinstance(f, EqualNullSafe):
                fits = value == f.value
            else:
                fits = value is not None and value == f.value
            if not fits:
                return None
        return row


class Decoded:
    """How many payload bytes this process has decoded (for tests and tuning)."""

    payload_bytes = 0


def _finish(row: dict, headers: dict[str, str], body: bytes) -> dict:
    row["payload"] = body[: int(headers.get("content-length", len(body)))]
    Decoded.payload_bytes += len(row["payload"])
    return row


def _inflate_head(pull, inflate) -> tuple[bytes, bytes]:
    """(header block, what was inflated beyond it), pulling as little as it takes."""
    plain = b""
    while (at := plain.find(b"\r\n\r\n")) < 0:
        chunk = inflate.unconsumed_tail or pull()
        if not chunk:
            raise ValueError("a record's headers do not end")
        plain += inflate.decompress(chunk, _PEEK)
    return plain[:at], plain[at + 4 :]


def read_records(file: BinaryIO, wanted: _Wanted) -> Iterator[dict]:
    """The wanted records of one archive, plain or gzip by record."""
    while True:
        start = file.tell()
        magic = file.read(2)
        if not magic:
            return
        if magic == b"\r\n":  # between plain records
            continue
        file.seek(start)
        yield from (_gzip_record if magic == b"\x1f\x8b" else _plain_record)(file, wanted)


def _plain_record(file: BinaryIO, wanted: _Wanted) -> Iterator[dict]:
    start, block = file.tell(), b""
    while (at := block.find(b"\r\n\r\n")) < 0:
        more = file.read(_PEEK)
        if not more:
            raise ValueError("a record's headers do not end")
        block += more
    headers = parse_headers(block[:at])
    length = int(headers.get("content-length", 0))
    row = wanted.row(headers)
    if row is not None:
        if wanted.payload:
            file.seek(start + at + 4)
            row = _finish(row, headers, file.read(length))
        yield row
    file.seek(start + at + 4 + length)


def _gzip_record(file: BinaryIO, wanted: _Wanted) -> Iterator[dict]:
    start = file.tell()
    _, _, flags, _, _, _ = _GZIP_HEAD.unpack(file.read(_GZIP_HEAD.size))
    named = None
    if flags == 4:
        extra, mark, size, length, _ = _SKIP.unpack(file.read(_SKIP.size))
        if (extra, mark, size) == (12, b"sl", 8):
            named = length
    if named is None:
        file.seek(start)
        yield from _unnamed_member(file, wanted)
        return
    begin = file.tell()
    pull = lambda: file.read(min(_PEEK, begin + named - file.tell()))
    inflate = zlib.decompressobj(-zlib.MAX_WBITS)
    block, rest = _inflate_head(pull, inflate)
    headers = parse_headers(block)
    row = wanted.row(headers)
    if row is not None:
        if wanted.payload:
            left = inflate.unconsumed_tail + file.read(begin + named - file.tell())
            row = _finish(row, headers, rest + inflate.decompress(left))
        yield row
    file.seek(begin + named + 8)


def _unnamed_member(file: BinaryIO, wanted: _Wanted) -> Iterator[dict]:
    """A member of a foreign archive: its end is only found by inflating it."""
    inflate = zlib.decompressobj(16 + zlib.MAX_WBITS)
    block, rest = _inflate_head(lambda: file.read(_PEEK), inflate)
    headers = parse_headers(block)
    row = wanted.row(headers)
    keep = row is not None and wanted.payload
    parts = [rest]
    while not inflate.eof:
        chunk = inflate.unconsumed_tail or file.read(1 << 16)
        if not chunk:
            raise ValueError("a gzip member is cut off")
        part = inflate.decompress(chunk, 1 << 20)
        if keep:
            parts.append(part)
    file.seek(file.tell() - len(inflate.unused_data))
    if row is not None:
        yield _finish(row, headers, b"".join(parts)) if keep else row


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            simple = isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull))
            if simple and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[_Files]:
        fs, root = filesystem(self.path)
        if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
            return [_Files((root,))]
        files = [i for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if i.is_file]
        found = [i for i in files if re.search(r"\.warc(\.gz)?$", i.path)]
        manifests = [i.path for i in files if re.fullmatch(r"_manifest.*\.json", i.base_name)]
        if manifests:
            listed: set[str] = set()
            for path in manifests:
                with fs.open_input_stream(path) as f:
                    listed.update(json.loads(f.read()))
            found = [i for i in found if i.base_name in listed]
        runs: list[list[str]] = []
        size = self.partition_bytes
        for info in sorted(found, key=lambda i: i.path):
            if size + info.size > self.partition_bytes:
                runs.append([])
                size = 0
            runs[-1].append(info.path)
            size += info.size
        return [_Files(tuple(r)) for r in runs] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        wanted, rows, size = _Wanted(self.filters, self.payload), [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for row in read_records(file, wanted):
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size > _ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for record in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                    if out is None or size > self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    member = encode(record)
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return _Written(tuple(files))

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        # A list of its own for every write, so that a later append leaves the earlier ones valid.
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m is not None for x in m.files)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = filesystem(self.path)
        for message in messages:
            for name in message.files if message is not None else ():
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("strata_warc")`` and ``df.write.format("strata_warc")``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it take part in filter push-down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archive(records: DataFrame, path: str) -> None:
    """Write records that have the columns of :data:`SCHEMA` (missing ones are null)."""
    register(records.sparkSession)
    have = set(records.columns)
    columns = [c.split() for c in SCHEMA.split(", ")]
    cast = [F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in columns]
    records.select(*cast).write.format(NAME).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Records for (page_id, url, html): of equal payloads the least page is the response.

    Payloads under ``min_shared`` bytes are always responses. A repeated row of the least
    page is a response too; a page without an id revisits if there is one with an id.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.cast("binary").alias("payload")
    ).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    shared = rows.where(F.col("payload_bytes") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").select("digest", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return rows.join(shared, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        "target_uri",
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, name("first")).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
