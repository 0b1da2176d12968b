"""WARC archives as a Spark data source, written and read by tasks, and the de-duplicated archive of a pages table.

``format("warc")`` writes one gzip member (or a plain record) per row. Tasks write files of their own names; the commit lists the
files of the successful tasks in ``_files.json``, and readers take that list where it stands, so a lost or repeated task leaves
nothing that is read. Members carry their length in a gzip header field.

Reading plans partitions over files (whole ones, small ones together), since only the chain of records shows where one starts.
Headers are parsed first. Filters on record type, record id, target URI, date, digest, refers-to, content type and length are taken
over by the reader; a record that fails one, or whose payload the asked-for schema lacks, is skipped: by a seek in plain files and
members of known length, else by inflating to nowhere. Give a schema (``spark.read.format("warc").schema(...)``) to leave the
payload out.

Branches of one plan that filter differently need a ``load`` each (``read_archive``): Spark 4.1 keeps the pushed filters with the
loaded relation, so two filters on one loaded frame would both read by the second.

Paths may be local, ``file:``, or any store that Arrow's file systems reach (s3, gs, hdfs with its library).

Defined results of the page archive: null html counts as empty. Payloads shorter than the limit are all responses. Of equal payloads
the row of smallest page_id is the response, ties by url, nulls last; of wholly equal rows exactly one. Pages without rows give an empty archive and
no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

# Names of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_OF = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}

SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
          "content_type string, content_length long, headers map<string,string>, http_headers map<string,string>, payload binary, path string")
MANIFEST = "_files.json"
CHUNK = 1 << 16
ROWS, BYTES = 1000, 8 << 20


# --- files ---

def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = re.sub(r"^s3[an]:", "s3:", path)
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    return (pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:", path) else (pa.fs.LocalFileSystem(), os.path.abspath(path)))


def archive_files(path: str) -> list[tuple[str, int]]:
    """(file, bytes): those that a commit lists, else all files named as archives below the path; or the one file at the path."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == pa.fs.FileType.File:
        return [(root, info.size)]
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pa.fs.FileType.File:
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            return [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
    found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pa.fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path))


# --- records ---

def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), value)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A member whose extra field 'sl' holds its own length and that of the data, both where they fit in 32 bits."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(packed) + 8
    if size >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + packed + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data)) + packed + tail


class Source:
    """Bytes of a file from a position on, held a chunk at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def need(self, n: int) -> bytes:
        """At least n bytes from here if the file has them; they stay unread."""
        while len(self.held) < n and (more := self.file.read(max(CHUNK, n - len(self.held)))):
            self.held += more
        return self.held

    def drop(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(self.at + n)
            self.held = b""
        self.at += n


class Plain:
    """The records of an uncompressed file; what is skipped is not read."""

    def __init__(self, source: Source):
        self.source, self.need, self.drop = source, source.need, source.drop

    def open(self) -> bool:
        while (held := self.source.need(2))[:2] == b"\r\n":
            self.source.drop(2)
        return bool(held)

    def skip_rest(self, left: int) -> None:
        self.source.drop(left)


class Gzip:
    """The records of a file of gzip members, one record each or several."""

    def __init__(self, source: Source):
        self.source, self.inflate, self.held, self.end = source, None, b"", None

    def open(self) -> bool:
        while True:
            if self.need(2)[:2] == b"\r\n":
                self.drop(2)
            elif self.held:
                return True
            elif not self._member():
                return False

    def _member(self) -> bool:
        head = self.source.need(26)
        if not head:
            return False
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {self.source.at}")
        self.end = None
        if head[3] & 4 and head[12:14] == b"sl" and struct.unpack("<H", head[14:16])[0] == 8:
            self.end = self.source.at + struct.unpack("<I", head[16:20])[0]
        self.inflate = zlib.decompressobj(31)
        return True

    def need(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n and self.inflate is not None:
            data = self.source.need(1)
            out = self.inflate.decompress(data, max(CHUNK, n - have))
            left = len(self.inflate.unused_data) if self.inflate.eof else len(self.inflate.unconsumed_tail)
            self.source.drop(len(data) - left)
            if self.inflate.eof:
                self.inflate = None
            elif not data:
                raise ValueError(f"gzip member is cut off at {self.source.at}")
            parts.append(out)
            have += len(out)
        self.held = b"".join(parts) if len(parts) > 1 else self.held
        return self.held

    def drop(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self.need(1):
                raise ValueError(f"record is cut off at {self.source.at}")
        self.held = self.held[n:]

    def skip_rest(self, left: int) -> None:
        """Past the record; past its member without inflating where the member is known to hold this record alone."""
        if self.end is not None:
            self.source.drop(self.end - self.source.at)
            self.inflate, self.held, self.end = None, b"", None
        else:
            self.drop(left)


def _head(reader, lead: bytes = b"") -> dict[str, str]:
    """Header lines up to the empty one, continued lines joined; of repeated names the first."""
    n = CHUNK
    while (at := (held := reader.need(n)).find(b"\r\n\r\n")) < 0:
        if len(held) < n:
            raise ValueError("header is cut off")
        n *= 2
    lines = held[:at].decode("utf-8", "replace").split("\r\n")
    reader.drop(at + 4)
    if lead and not lines[0].encode().startswith(lead):
        raise ValueError(f"no record here: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip()
            if name in out:
                name = None
            else:
                out[name] = value.strip()
    return out


def _parsed_http(block: bytes) -> tuple[dict[str, str], bytes]:
    at = block.find(b"\r\n\r\n")
    if at < 0:
        return {}, block
    out = {}
    for line in block[:at].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip(), value.strip())
    return out, block[at + 4 :]


# --- reading ---

@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


def _test(f):
    """A test of a record's header fields for a pushed filter, or None."""
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return lambda v: v == f.value if v is not None else f.value is None and isinstance(f, EqualNullSafe)
    if isinstance(f, In):
        return lambda v: v is not None and v in f.value
    if isinstance(f, IsNotNull):
        return lambda v: v is not None
    if isinstance(f, IsNull):
        return lambda v: v is None
    for kind, test in ((GreaterThan, lambda v, x: v > x), (GreaterThanOrEqual, lambda v, x: v >= x), (LessThan, lambda v, x: v < x), (LessThanOrEqual, lambda v, x: v <= x),
                       (StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)):
        if isinstance(f, kind):
            return lambda v, test=test: v is not None and test(v, f.value)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.names, self.partition_bytes = path, schema.names, partition_bytes
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if len(f.attribute if hasattr(f, "attribute") else ()) == 1 and (f.attribute[0] in HEADER_OF or f.attribute[0] == "content_length") and _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        groups: list[Files] = []
        room = 0
        for name, size in archive_files(self.path):
            if not groups or size > room:
                groups.append(Files([]))
                room = self.partition_bytes
            groups[-1].files.append((name, size))
            room -= size
        return groups or [Files([])]

    def read(self, partition: Files):
        fs, _ = file_system(self.path)
        tests = [(f.attribute[0], _test(f)) for f in self.filters]
        rows, held = [], 0
        for name, size in partition.files:
            with fs.open_input_file(name) as file:
                for row in self.records(file, size, name, tests):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= ROWS or held >= BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def records(self, file, size: int, name: str, tests: list) -> Iterator[dict]:
        source = Source(file, size)
        reader = Gzip(source) if source.need(2)[:2] == b"\x1f\x8b" else Plain(source)
        block_wanted = bool({"payload", "http_headers"} & set(self.names))
        while reader.open():
            headers = _head(reader, b"WARC/")
            lower = {k.lower(): v for k, v in headers.items()}
            length = int(lower.get("content-length", "0"))
            row = {c: lower.get(h.lower()) for c, h in HEADER_OF.items()}
            row |= {"content_length": length, "headers": headers, "path": name, "payload": None, "http_headers": None}
            if not all(test(row[c]) for c, test in tests):
                reader.skip_rest(length)
                continue
            if block_wanted:
                block = reader.need(length)[:length]
                if len(block) < length:
                    raise ValueError(f"record is cut off in {name}")
                is_http = (row["content_type"] or "").lower().startswith("application/http")
                row["http_headers"], row["payload"] = _parsed_http(block) if is_http else ({}, block)
                reader.drop(length)
            else:
                reader.skip_rest(length)
            yield row

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "http_headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        columns = [[list(r[c].items()) if isinstance(r[c], dict) else r[c] for r in rows] for c in self.names]
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in zip(self.names, columns)], names=self.names)


# --- writing ---

@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, date, payload_digest, refers_to, content_type, payload, headers (further header
    fields), http_headers (null: the block is the payload itself); absent columns count as null."""

    def __init__(self, path: str, compress: bool, level: int, file_bytes: int):
        self.path, self.compress, self.level, self.file_bytes = path, compress, level, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        out, files, size, name = None, [], 0, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    data = self.record(row)
                    if out is None or size >= self.file_bytes:
                        if out:
                            out.close()
                            files.append((name, size))
                        name, size = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
                files.append((name, size))
        return Written(files)

    def record(self, row: dict) -> bytes:
        payload, http = row.get("payload") or b"", row.get("http_headers")
        if http is not None:
            payload = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in http) + "\r\n").encode() + payload
        row = {**row, "record_id": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"}
        headers = [(h, row.get(c)) for c, h in HEADER_OF.items()] + list(row.get("headers") or [])
        data = record_bytes(headers, payload)
        return gzip_member(data, self.level) if self.compress else data

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """Options: path; partition_bytes (128 MiB) of files in one read partition; compress (true), level (6), file_bytes (1 GiB) for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", 128 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        fs, root = file_system(self.options["path"])
        if not overwrite and fs.get_file_info(f"{root}/{MANIFEST}").type != pa.fs.FileType.NotFound:
            raise ValueError(f"{self.options['path']} holds an archive already")
        return WarcWriter(self.options["path"], self.options.get("compress", "true").lower() == "true", int(self.options.get("level", 6)), int(self.options.get("file_bytes", 1 << 30)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let its filters be pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of an archive, loaded anew; of the schema's columns, payload and http_headers alone need the blocks."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


# --- pages ---

def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_column(data: Column) -> Column:
    """Base32 of SHA-1, four runs of 40 bits at a time."""
    h = F.sha1(data)
    runs = [F.lpad(F.conv(F.substring(h, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of pages: a response for each payload, a revisit without payload for each further row of it. Rows meet the first row
    of their payload in one join, which adaptive execution may split where one payload is frequent."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("n"), F.coalesce(digest_column(F.col("payload")), F.lit("")).alias("digest"))
    key = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"), F.col("url").isNull().alias("no_url"), F.col("url").alias("u"))
    same = rows.where(F.col("n") >= least_bytes).groupBy("digest", key.alias("key")).agg(F.count("*").alias("c"))
    first = same.groupBy("digest").agg(F.min(F.struct("key", "c")).alias("f"), F.sum("c").alias("all")).where(F.col("all") > 1)
    met = rows.join(first.select("digest", "f"), "digest", "left")
    is_first = F.col("f").isNull() | (key <= F.col("f.key"))  # no smaller key exists; as an equality it would become a join key and a second shuffle
    own = F.coalesce(F.col("f.c"), F.lit(1)) == 1
    # Of several wholly equal first rows one is the response.
    again = met.where(is_first & ~own).groupBy("digest", "page_id", "url").agg(F.first("payload").alias("payload"), F.first("n").alias("n"), F.first("f").alias("f"))
    again = again.select("page_id", "url", "payload", "n", "digest", "f", F.explode(F.sequence(F.lit(1).cast("long"), F.col("f.c"))).alias("k")).withColumn("response", F.col("k") == 1).drop("k")
    decided = met.where(~is_first | own).select("page_id", "url", "payload", "n", "digest", "f", is_first.alias("response")).unionByName(again)
    md5 = F.md5(F.concat(F.lit("response:"), "digest"))
    leader = F.concat(F.lit("<urn:uuid:"), *(x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(md5, k, n), F.lit("-" if k < 21 else ">"))))
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    revisit = ~F.col("response")
    return decided.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(F.col("response") & (F.col("n") >= least_bytes), leader).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("1970-01-01T00:00:00Z").alias("date"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, leader).alias("refers_to"), F.lit("application/http; msgtype=response").alias("content_type"),
        F.when(F.col("response"), F.col("payload")).alias("payload"),
        F.map_filter(F.create_map(F.lit("WARC-Profile"), F.when(revisit, REVISIT_PROFILE), F.lit("X-Page-ID"), number(F.col("page_id")),
                                  F.lit("X-Refers-To-Page-ID"), F.when(revisit, number(F.col("f.key.id")))), lambda _, v: v.isNotNull()).alias("headers"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.col("n").cast("string")).alias("http_headers"))


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").option("level", "4").save(path)


def read_pages(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive of pages. Length and digest of a response are
    those of the payload read, and a digest that its header does not name is an error; a revisit's are in its headers."""
    read = [read_archive(spark, path, "record_type string, payload_digest string, headers map<string,string>, http_headers map<string,string>, payload binary") for _ in range(2)]
    number = lambda name: F.nullif(F.col("headers")[name], F.lit("")).cast(id_type)
    named = F.substring("payload_digest", 6, 32)
    whole = read[0].where(F.col("record_type") == "response").select(
        number("X-Page-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest_column(F.col("payload")).alias("payload_digest"),
        named.alias("named"), "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    whole = whole.withColumn("payload_digest", F.when(F.col("named") == F.col("payload_digest"), F.col("named")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))).drop("named")
    again = read[1].where(F.col("record_type") == "revisit").select(
        number("X-Page-ID").alias("page_id"), F.col("http_headers")["Content-Length"].cast("long").alias("payload_bytes"), named.alias("payload_digest"),
        "record_type", number("X-Refers-To-Page-ID").alias("refers_to"))
    return whole.unionByName(again)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="warc-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{shared.rstrip('/')}/warc-{uuid.uuid4().hex}"


def archive_report(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as an archive and read it back."""
    spark = pages.sparkSession
    path = archive_folder(spark)
    write_pages(pages, path, least_bytes)
    return read_pages(spark, path, dict(pages.dtypes)["page_id"])
