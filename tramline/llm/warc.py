"""WARC archives: a writer, and a Python data source that reads them.

Archives are written one per partition, each record a gzip member of its own whose
header tells its compressed length (the "sl" extra field of the WARC standard). A
file appears under its final name only when it is whole, so a task that runs again
replaces it. Records of equal payloads of at least `least` bytes are written once
as a response; the others are revisit records that refer to it.

The reader plans one partition for each group of files, takes predicates on the
record type and on headers, parses a record's headers from its first bytes and
steps over the rest of the member, undecoded, where a predicate fails or no payload
is wanted.

Nulls: a null payload is an empty one; a record with a null id is always a
response and is named by none; a null address has no header. Rows that tie for the
smallest id of a payload are all responses. Empty payloads are payloads. An empty
table gives no archives and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from tramline.llm.common import column, fresh_path, materialize, salt, slices

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
# Fixed value: the standard's profile of revisits with equal payload digests.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, URN = "1970-01-01T00:00:00Z", "urn:page:"
#: Files are read in partitions of about so many bytes.
PARTITION_BYTES = 64 << 20
_MEMBER = struct.Struct("<4sLBBH2sHLL")  # gzip header with one extra field: "sl", 8 bytes long
_BREAK = re.compile(r"[\x00-\x1f\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 6) -> bytes:
    """record as a gzip member; its extra field holds the compressed and the plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, len(body) + _MEMBER.size + 8, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<LL", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(number: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or a revisit of the record of page `first`."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if number is None else number}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _BREAK.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <{URN}{first}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes (id, url, payload, first) to archives under path; returns (file, records, bytes), one row an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name, n, size, out = f"{root}/part-{task.partitionId():06d}.warc.gz", 0, 0, None
        for part, payloads in slices(batches, "payload"):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(tmp := f"{root}/.{task.taskAttemptId()}.tmp", compression=None)
            rows = zip(*(column(part, c).to_pylist() for c in ("id", "url")), payloads, column(part, "first").to_pylist(), strict=True)
            for row in rows:
                out.write(data := member(record(*row)))
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            store.move(tmp, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["file", "records", "bytes"])

    return materialize(pages.mapInArrow(run, "file string, records bigint, bytes bigint"), "op10-archives")


def plain(value: str | None) -> str | None:
    """A header's value without the marks around ids and before digests."""
    return value and value.strip().removeprefix("<").removesuffix(">").removeprefix("sha1:")


class Member:
    """One record in an open file, decoded as far as it is asked for."""

    def __init__(self, source: object, at: int):
        self.source = source
        source.seek(at)
        data = source.read(4096)
        if data[:4] != b"\x1f\x8b\x08\x04" or data[12:14] != b"sl":
            raise ValueError(f"no WARC member with a skip length at byte {at}")
        (self.length,) = struct.unpack_from("<L", data, 16)
        self.left, self.unpack = max(0, self.length - len(data)), zlib.decompressobj(31)
        self.plain = self.unpack.decompress(data[: self.length], 16384)

    def more(self) -> bool:
        """Decodes another part; False at the end."""
        if self.unpack.eof:
            return False
        data = self.unpack.unconsumed_tail
        if not data:
            data = self.source.read(min(self.left, 1 << 18))
            self.left -= len(data)
        if not data:
            return False
        self.plain += self.unpack.decompress(data, 1 << 22)
        return True

    def head(self) -> tuple[bytes, bytes, int]:
        """The record's headers, its block's headers, and where its payload starts."""
        while self.plain.count(b"\r\n\r\n") < 2 and self.more():
            pass
        first = self.plain.find(b"\r\n\r\n")
        second = self.plain.find(b"\r\n\r\n", first + 4)
        return self.plain[:first], self.plain[first + 4 : second], second + 4

    def payload(self, start: int, n: int) -> bytes:
        parts, size = [self.plain], len(self.plain)
        while size < start + n:
            self.plain = b""
            if not self.more():
                break
            parts.append(self.plain)
            size += len(self.plain)
        return b"".join(parts)[start : start + n]


def parsed(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


class Files(InputPartition):
    def __init__(self, uri: str, files: list[tuple[str, int]]):
        self.uri, self.files = uri, files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.verify = options["path"], options.get("payload", "true") == "true", options.get("verify", "false") == "true"
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and prefix tests on what headers hold; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in HEADERS:
                self.wanted.append((name, "in", {f.value}))
            elif isinstance(f, In) and name in HEADERS:
                self.wanted.append((name, "in", set(f.value)))
            elif isinstance(f, StringStartsWith) and name in HEADERS:
                self.wanted.append((name, "prefix", f.value))
            elif isinstance(f, IsNotNull) and name in HEADERS:
                self.wanted.append((name, "there", None))
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        """Archives in groups of about PARTITION_BYTES."""
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return [Files(self.path, [])]
        found = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(".warc.gz"))
        groups, size = [[]], 0
        for x in found:
            if groups[-1] and size + x[1] > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(x)
            size += x[1]
        return [Files(self.path, g) for g in groups]

    def passes(self, row: dict[str, str | None]) -> bool:
        for name, how, value in self.wanted:
            x = row[name]
            if x is None or (how == "in" and x not in value) or (how == "prefix" and not x.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(partition.uri)
        rows, held = [], 0
        for path, size in partition.files:
            with store.open_input_file(path) as source:
                at = 0
                while at < size:
                    record = Member(source, at)
                    at += record.length
                    head, http, start = record.head()
                    found = parsed(head)
                    row = {c: plain(found.get(h.lower())) for c, h in HEADERS.items()}
                    if not self.passes(row):
                        continue
                    n, payload = int(parsed(http).get("content-length", 0)), None
                    if (self.payload or self.verify) and row["record_type"] == "response":
                        payload = record.payload(start, n)
                        if len(payload) != n or (self.verify and digest(payload) != row["payload_digest"]):
                            raise ValueError(f"{row['record_id']}: the payload does not have the length or digest that its headers tell")
                    rows.append((*(row[c] for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")), n, payload if self.payload else None))
                    held += n
                    if len(rows) >= 4_000 or held >= 8 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * 5, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


class WarcSource(DataSource):
    """spark.read.format("warc").load(path); options: payload (true), verify (false)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_first(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """(id, url, payload, first): first is the page that a revisit refers to, else null.

    The smallest id of a payload is found from digests alone, in two steps, so many copies of one page are no hot key.
    """
    pages = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    keyed = pages.withColumn("hash", F.sha2("payload", 256)).withColumn("salt", salt("id"))
    part = keyed.groupBy("hash", "salt").agg(F.min("id").alias("low"))
    low = part.groupBy("hash").agg(F.min("low").alias("low"))
    first = F.when((F.col("low") < F.col("id")) & (F.octet_length("payload") >= least), F.col("low"))
    return keyed.join(part.select("hash", "salt").join(low, "hash"), ["hash", "salt"]).select("id", "url", "payload", first.alias("first"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the archives and reads them back: (id, payload_bytes, payload_digest, record_type, refers_to, target_uri)."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(with_first(pages, id_col, url_col, text_col, least), path)
    register(spark)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) as bigint)")
    rows = spark.read.format("warc").option("payload", "false").option("verify", "true").load(path).where(F.col("record_type").isin("response", "revisit"))
    return rows.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
