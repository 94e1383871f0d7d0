"""WARC files as a Spark data source, for reading and writing.

``spark.read.format("warc").load(path)`` plans the files of a folder into
partitions of about ``partitionBytes``, small files together. A file is the unit:
a payload may hold whole records, so no position inside a file is known to begin
one unless the file is followed from its start. Predicates on the columns of the
WARC header, the record type among them, are pushed down and judged after the
header alone; those on the HTTP columns after the HTTP header. A payload that is
not wanted is neither decoded nor, where the file tells its size, read: plain
files are seeked, and so are gzip members with the skip lengths ("sl") that the
format's appendix describes and that the writer puts in. Names of fields count in
any case. Option ``payload`` is
``true`` or ``false`` (the column is null, and no payload is decoded at all).

``df.write.format("warc").save(path)`` writes one gzip member for each record.
Files have names of their own for each attempt of a task; the driver lists those
that count in ``_FILES``, so attempts that failed or ran twice leave nothing that
is read.

Defined cases: a null column is a header field that is absent, a null payload a
record with the field ``WARC-X-Null-Payload``; a null type is read as null. Values
with line ends or outer blanks travel as encoded words, so they come back as they
were. An empty payload is empty, not null. Repeated records stay repeated. Text
that isn't valid UTF-8 is decoded by the charset the HTTP header names, else as
Latin-1. A folder without files gives no rows; a file that breaks off inside a
record, wanted or not, raises an error that names the file and the place. Extra columns are not
written.
"""

from __future__ import annotations

import base64
import io
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import shared_dir

PARTITION_BYTES = 128 << 20
FILE_BYTES = 1 << 30
BATCH_BYTES = 8 << 20
HEAD = 1 << 14
SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length bigint, http_status int, http_type string, headers map<string,string>, payload string"
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type", "content_length": "Content-Length"}
HTTP = ("http_status", "http_type")
NULL = "WARC-X-Null-Payload"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/")[0] else "file://" + posixpath.abspath(path))


def encoded(value: str) -> str:
    if re.search(r"[\r\n]|^\s|\s$|^=\?", value):
        return "=?utf-8?B?" + base64.b64encode(value.encode()).decode() + "?="
    return value


def decoded(value: str) -> str:
    m = re.fullmatch(r"=\?utf-8\?B\?([A-Za-z0-9+/=]*)\?=", value, re.I)
    return base64.b64decode(m[1]).decode("utf-8", "replace") if m else value


class Fields(dict):
    """The fields of a header by the names that they came with; of() finds them whatever the case."""

    def __init__(self):
        super().__init__()
        self.names: dict[str, str] = {}

    def of(self, name: str, default: str | None = None) -> str | None:
        own = self.names.get(name.lower())
        return default if own is None else self[own]

    def add(self, name: str, value: str) -> None:
        self.names[name.lower()] = name
        self[name] = value


def parsed(head: bytes) -> Fields:
    """The fields of a header without its first line; a folded line continues the one before, and of repeated fields, in whatever case, the first counts."""
    out = Fields()
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip()
        last = None
        if colon and name.lower() not in out.names:
            last = name
            out.add(name, decoded(value.strip()))
    return out


class Text:
    """Reads on demand from a plain file, or from one gzip member."""

    def __init__(self, pull):
        self.pull, self.buf = pull, bytearray()
        #: bytes that came from the file or member so far
        self.given = 0

    def until(self, end: bytes, most: int = 1 << 24) -> bytes | None:
        seen = 0
        while (at := self.buf.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.buf)
            more = self.pull(HEAD)
            if not more or seen > most:
                return None
            self.buf += more
            self.given += len(more)
        out = bytes(self.buf[:at])
        del self.buf[: at + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and (more := self.pull(max(HEAD, n - len(self.buf)))):
            self.buf += more
            self.given += len(more)
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


class Member:
    """The text of the gzip member that begins at the file's position."""

    def __init__(self, file, start: int, size: int | None):
        self.file, self.z, self.size, self.start = file, zlib.decompressobj(31), size, start
        file.seek(start)

    def pull(self, n: int) -> bytes:
        out = b""
        while not out and not self.z.eof:
            raw = self.z.unconsumed_tail or self.file.read(HEAD)
            if not raw:
                raise EOFError("a gzip member breaks off")
            out = self.z.decompress(raw, n)
        return out

    def end(self) -> int:
        """Where the next member begins; without skip lengths, the rest is inflated and thrown away."""
        if self.size:
            return self.start + self.size
        while not self.z.eof:
            self.pull(1 << 20)
        return self.file.tell() - len(self.z.unused_data)


def skip_lengths(file, start: int) -> tuple[int | None, int | None]:
    """The compressed and the uncompressed size that the gzip header at start tells, if it does; at the file's end -1."""
    file.seek(start)
    head = file.read(24)
    if not head:
        return -1, None
    if len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl" and head[14:16] == b"\x08\0":
        size, whole = struct.unpack("<II", head[16:24])
        return (size, whole) if size else (None, None)
    return None, None


def header(text: Text, start: int) -> bytes | None:
    """The next record's header, without the blank lines before it; None where only blanks are left."""
    head = b""
    while not head.strip():
        head = text.until(b"\r\n\r\n")
        if head is None:
            left = bytes(text.buf)
            if left.strip() or len(left) > 1 << 24:
                raise EOFError(f"a record breaks off, or its header does not end, after byte {start}")
            return None
    return head.lstrip(b"\r\n")


class Body:
    """What follows a record's header: n bytes, read when asked for."""

    def __init__(self, text: Text, n: int, start: int):
        self.text, self.left, self.start = text, n, start

    def take(self, n: int) -> bytes:
        got = self.text.take(min(n, self.left))
        self.left -= len(got)
        if len(got) < n and self.left:
            raise EOFError(f"a record breaks off after byte {self.start}")
        return got

    def head(self, end: bytes = b"\r\n\r\n") -> bytes:
        """Up to the first blank line, and no more than that by a buffer; all of it if there is none."""
        seen = bytearray()
        while self.left:
            seen += self.take(min(len(self.text.buf) or HEAD, self.left))
            at = seen.find(end)
            if at >= 0:
                back = seen[at + len(end) :]
                self.text.buf[:0] = back
                self.left += len(back)
                return bytes(seen[:at])
        return bytes(seen)

    def rest(self) -> bytes:
        return self.take(self.left)

    def skip(self) -> None:
        while self.left:
            self.take(min(self.left, 1 << 20))


def records(file, wanted, gzip: bool) -> Iterator[tuple[Fields, Body]]:
    """The header of every record that is wanted, and its body. What isn't asked for is skipped.

    A gzip member may hold any number of records. The skip lengths of its header tell
    its size and that of its text, so it is left by a seek if the record ends it.
    """
    start, end = 0, file.seek(0, 2)
    end = file.tell() if end is None else end
    broken = EOFError(f"a record breaks off at the file's end, byte {end}")
    while True:
        if gzip:
            size, whole = skip_lengths(file, start)
            if size == -1:
                return
            if size and start + size > end:
                raise broken
            member = Member(file, start, size)
            text = Text(member.pull)
        else:
            file.seek(start)
            text, member, whole = Text(file.read), None, None
        while (head := header(text, start)) is not None:
            fields = parsed(head)
            n = int(fields.of("Content-Length", "0"))
            seen = text.given - len(text.buf) + n
            body = Body(text, n, start)
            if wanted(fields):
                yield fields, body
            if not gzip:
                start += seen
                if start > end:
                    raise broken
                break
            if whole is not None and 0 <= whole - seen <= 4:
                break  # nothing is left but the line ends behind the record
            body.skip()
        else:
            if not gzip:
                return
        if gzip:
            start = member.end()


def compare(f: Filter, get) -> bool:
    """Whether a row whose columns get() returns passes the filter, as SQL does: null fails but for the null tests."""
    if isinstance(f, Not):
        child = f.child
        if isinstance(child, (EqualNullSafe, IsNull, IsNotNull)):
            return not compare(child, get)
        return get(child.attribute[0]) is not None and getattr(child, "value", 0) is not None and not compare(child, get)
    x = get(f.attribute[0])
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if x is None or f.value is None:
        return False
    ops = {
        EqualTo: lambda: x == f.value, In: lambda: x in f.value, GreaterThan: lambda: x > f.value, GreaterThanOrEqual: lambda: x >= f.value, LessThan: lambda: x < f.value,
        LessThanOrEqual: lambda: x <= f.value, StringStartsWith: lambda: x.startswith(f.value), StringEndsWith: lambda: x.endswith(f.value), StringContains: lambda: f.value in x,
    }
    return ops[type(f)]()


def column(fields: Fields, name: str):
    value = fields.of(FIELDS[name])
    return int(value) if name == "content_length" and value is not None else value


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.size = int(options.get("partitionBytes", options.get("partitionbytes", PARTITION_BYTES)))
        self.payload = options.get("payload", "true").lower() != "false"
        self.warc_filters: list[Filter] = []
        self.http_filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            bare = f.child if isinstance(f, Not) else f
            simple = isinstance(bare, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains, IsNull, IsNotNull))
            nulls = isinstance(f, Not) and isinstance(bare, In) and None in bare.value
            if simple and not nulls and bare.attribute[0] in FIELDS:
                self.warc_filters.append(f)
            elif simple and not nulls and bare.attribute[0] in HTTP:
                self.http_filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            found = [info]
        else:
            found = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.base_name) and not x.base_name.startswith(("_", "."))]
            listed = f"{root}/_FILES"
            if fs.get_file_info(listed).is_file:
                with fs.open_input_stream(listed) as f:
                    names = set(json.loads(f.read()))
                found = [x for x in found if x.base_name in names]
        out: list[list[str]] = []
        room = 0
        for x in sorted(found, key=lambda x: (-x.size, x.path)):
            if not out or x.size > room:
                out.append([])
                room = self.size
            out[-1].append(x.path)
            room -= x.size
        return [Files(p) for p in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        kinds = {"content_length": pa.int64(), "http_status": pa.int32(), "headers": pa.map_(pa.string(), pa.string())}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)

        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                file = io.BufferedReader(raw, 1 << 16) if isinstance(raw, io.RawIOBase) else raw
                try:
                    for fields, body in records(file, lambda x: all(compare(f, lambda c: column(x, c)) for f in self.warc_filters), path.endswith(".gz")):
                        row, size = self.row(fields, body)
                        if row:
                            rows.append(row)
                            held += size
                        if held > BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
                except (EOFError, ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield batch()

    def row(self, fields: Fields, body: Body) -> tuple[tuple | None, int]:
        """A row and its size, or None. Of a HTTP message, the header is judged before the payload is read."""
        status, kind, value = None, None, None
        kept = fields.of(NULL) is None
        if re.match(r"application/http\b", fields.of("Content-Type", "")) and kept:
            head = body.head()
            line = re.match(rb"HTTP/\S+\s+(\d{3})", head)
            status, kind = int(line[1]) if line else None, parsed(head).of("Content-Type")
        if not all(compare(f, {"http_status": status, "http_type": kind}.get) for f in self.http_filters):
            return None, 0
        size = 200
        if self.payload and kept:
            raw = body.rest()
            size += len(raw)
            value = text_of(raw, kind or fields.of("Content-Type", ""))
        return (*(column(fields, c) for c in FIELDS), status, kind, list(fields.items()), value), size


def text_of(body: bytes, kind: str) -> str:
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        named = re.search(r"charset=\"?([\w.:-]+)", kind or "")
        try:
            return body.decode(named[1] if named else "latin-1")
        except (LookupError, UnicodeDecodeError):
            return body.decode("latin-1")


def member(record: bytes, level: int) -> bytes:
    """A gzip member with its skip lengths."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size if size < 1 << 32 else 0, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    payload = row.get("payload")
    body = b"" if payload is None else payload.encode("utf-8", "surrogatepass") if isinstance(payload, str) else bytes(payload)
    fields = {name: row[c] for c, name in FIELDS.items() if c != "content_length" and row.get(c) is not None}
    fields |= {k: v for k, v in dict(row.get("headers") or ()).items() if v is not None and k not in FIELDS.values()}
    if payload is None:
        fields[NULL] = "1"
    elif row.get("http_status") is not None:
        kind = row.get("http_type")
        body = f"HTTP/1.1 {row['http_status']} \r\n".encode() + (f"Content-Type: {encoded(kind)}\r\n".encode() if kind is not None else b"") + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
        fields["Content-Type"] = "application/http; msgtype=response"
    fields["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {encoded(v)}\r\n" for k, v in fields.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 3)), overwrite
        self.size = int(options.get("fileBytes", options.get("filebytes", FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out, held = None, 0
        for b in iterator:
            for row in b.to_pylist():
                if out is None or held > self.size:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, held = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                held += out.write(member(record(row), self.level)) or 0
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        names = [n for m in messages if m for n in m.files]
        listed = f"{root}/_FILES"
        if fs.get_file_info(listed).is_file and not self.overwrite:
            with fs.open_input_stream(listed) as f:
                names += json.loads(f.read())
        with fs.open_output_stream(listed) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for n in m.files if m else []:
                if fs.get_file_info(f"{root}/{n}").is_file:
                    fs.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A request and a response for every page, with the columns that the writer takes."""
    page = F.map_from_arrays(F.array(F.lit("WARC-X-Page-ID")), F.array(F.col(id).cast("string")))
    head = lambda kind: F.format_string(f"<urn:page:%s:{kind}>", F.coalesce(F.col(id).cast("string"), F.lit("")))
    none = F.lit(None)
    both = F.array(
        F.struct(F.lit("request").alias("warc_type"), head("request").alias("record_id"), F.lit("text/plain").alias("content_type"), none.cast("int").alias("http_status"), none.cast("string").alias("http_type"), F.concat(F.lit("GET "), F.coalesce(F.col(url), F.lit("")), F.lit(" HTTP/1.1\r\n\r\n")).alias("payload")),
        F.struct(F.lit("response").alias("warc_type"), head("response").alias("record_id"), none.cast("string").alias("content_type"), F.lit(200).alias("http_status"), F.lit("text/html; charset=utf-8").alias("http_type"), F.col(html).alias("payload")),
    )
    return pages.select(F.explode(both).alias("r"), F.col(url).alias("target_uri"), page.alias("headers")).select("r.*", "target_uri", "headers")


def written_and_read(pages: DataFrame) -> DataFrame:
    """page_id, url and html of every page, from WARC files in the shared folder: only responses are decoded."""
    spark = pages.sparkSession
    register(spark)
    path = shared_dir(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    got = spark.read.format("warc").load(path).filter((F.col("warc_type") == "response") & F.col("record_id").startswith("<urn:page:"))
    return got.select(F.col("headers")["WARC-X-Page-ID"].cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.col("payload").alias("html"))
