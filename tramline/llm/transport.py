"""Media columns in MPEG transport streams.

A payload is cut into access units, each a packetised elementary packet with a
presentation timestamp, dealt over 188-byte transport packets on one PID behind a
program association and a program map table. Every few units the first packet
carries a clock reference and the random-access mark. The parser (`demux`) reads any
stream by the standard: it finds programs and their streams through the tables, checks
every continuity counter and table checksum, reassembles the packets and returns the
payloads with their timestamps and random-access points.

Texts are stored in UTF-8, padded with spaces to a positive multiple of `unit`.
Nulls: a null text is an empty text, that is one unit of spaces; null ids are
carried. Very long texts take more packets; counters wrap as the standard says.
Equal texts give equal streams, so repeated rows give equal results. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import column, materialize, slices
from tramline.llm.demux import PACKET, PAT_PID, SYNC, crc_mpeg, demux

# Fixed values of the transport stream standard.
STREAM_PRIVATE, PRIVATE_1, CLOCK = 0x06, 0xBD, 90_000
#: Own choices: table and stream PIDs, bytes of an access unit, units a second, units from one random-access point to the next.
PMT_PID, ES_PID, UNIT_BYTES, RATE, RANDOM_ACCESS = 0x1000, 0x0100, 12_288, 25, 4
UNIT = 192


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + b" " * (-len(text) % unit if text else unit)


def section(table: int, number: int, body: bytes) -> bytes:
    """A table section in one packet's payload, behind its pointer field."""
    data = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return (b"\0" + data + struct.pack(">L", crc_mpeg(data))).ljust(PACKET - 4, b"\xff")


def header(pid: int, start: bool, control: int, counter: int) -> bytes:
    return struct.pack(">BHB", SYNC, (start << 14) | pid, (control << 4) | (counter & 15))


TABLES = b"".join(
    header(pid, True, 1, 0) + data
    for pid, data in (
        (PAT_PID, section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))),
        (PMT_PID, section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_PRIVATE, 0xE000 | ES_PID, 0xF000))),
    )
)


def timestamp(ticks: int) -> bytes:
    """33 bits in five bytes, with the marks of a presentation time alone."""
    t = ticks & ((1 << 33) - 1)
    return struct.pack(">BHH", 0x21 | (t >> 30 << 1), ((t >> 15) & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)


def packed(elementary: bytes, counter: int, clock: int | None) -> tuple[bytes, int]:
    """The transport packets of one elementary packet; clock: of a random-access point."""
    field = b"" if clock is None else struct.pack(">BBLH", 7, 0x50, clock >> 1 & 0xFFFFFFFF, (clock & 1) << 15 | 0x7E00)
    first = min(len(elementary), PACKET - 4 - len(field))
    if first < PACKET - 4 and first + len(field) < PACKET - 4:
        room = PACKET - 4 - first - len(field)
        if not field:
            field = bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
        else:
            field = bytes([field[0] + room]) + field[1:] + b"\xff" * room
    out = [header(ES_PID, True, 3 if field else 1, counter), field, elementary[:first]]
    rest = np.frombuffer(elementary, np.uint8, offset=first)
    whole, tail = divmod(len(rest), PACKET - 4)
    if whole:
        body = np.empty((whole, PACKET), np.uint8)
        body[:, :3] = np.frombuffer(header(ES_PID, False, 1, 0)[:3], np.uint8)
        body[:, 3] = 0x10 | ((counter + 1 + np.arange(whole)) & 15)
        body[:, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, -1)
        out.append(body.tobytes())
    if tail:
        room = PACKET - 4 - tail
        out += [header(ES_PID, False, 3, counter + 1 + whole), bytes([room - 1]), b"\0" + b"\xff" * (room - 2) if room > 1 else b"", rest[-tail:].tobytes()]
    return b"".join(out), counter + 1 + whole + (tail > 0)


def encode(payload: bytes) -> bytes:
    out, counter = [TABLES], 0
    for i in range(0, len(payload), UNIT_BYTES):
        part, n = payload[i : i + UNIT_BYTES], i // UNIT_BYTES
        ticks = n * CLOCK // RATE
        elementary = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_1, len(part) + 8, 0x84, 0x80, 5) + timestamp(ticks) + part
        data, counter = packed(elementary, counter, ticks if n % RANDOM_ACCESS == 0 else None)
        out.append(data)
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    timestamps: list[int]
    random_access: list[int]
    packets: int


def decode(media: bytes) -> Stream:
    """The first stream of the first program, as `encode` writes it; `demux` reads all streams of any."""
    found = demux(media)
    if not found.streams:
        raise ValueError("no stream in any program")
    s = found.streams[0]
    if None in s.presented:
        raise ValueError("an elementary packet has no timestamp")
    return Stream(s.payload, s.presented, [t for t, m in zip(s.presented, s.random_access, strict=True) if m], found.packets)


def elementary_streams(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, program, pid, stream_type, payload, timestamps, decode_times, random_access, clocks): a row an elementary stream of each value; null media have none.

    timestamps and decode_times are in 90 kHz, null where a packet has none; clocks are the references on the stream's PID, in 27 MHz.
    """
    source = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).where("media is not null")
    kind = source.schema["id"].dataType.simpleString()
    names = ["program", "pid", "stream_type", "payload", "timestamps", "decode_times", "random_access", "clocks"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in slices(batches, "media"):
            rows, owner = [], []
            for k, data in enumerate(streams):
                found = demux(data)
                for s in found.streams:
                    owner.append(k)
                    rows.append((s.program, s.pid, s.kind, s.payload, s.presented, s.decoded, [t for t, m in zip(s.presented, s.random_access, strict=True) if m], found.clocks.get(s.pid, [])))
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([column(part, "id").take(pa.array(owner)), *cols], ["id", *names])

    schema = f"id {kind}, program int, pid int, stream_type int, payload binary, timestamps array<bigint>, decode_times array<bigint>, random_access array<bigint>, clocks array<bigint>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as a transport stream."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    return source.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """(id, carried columns, payload and media digests, timestamps, random_access, feature), read from the streams."""
    source = media.select(F.col(id_col).alias("id"), *carry, F.col(media_col).alias("media"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in slices(batches, "media"):
            rows = []
            for data in streams:
                s = decode(data)
                level = np.frombuffer(s.payload, np.uint8)
                feature = f"packets={s.packets};units={len(s.timestamps)};last_pts={s.timestamps[-1]};random_access={len(s.random_access)};mean={level.mean():.3f}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.timestamps, s.random_access))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([column(part, "id"), *(column(part, c) for c in carry), *cols], ["id", *carry, *names])

    schema = ", ".join([f"id {kinds['id']}", *(f"{c} {kinds[c]}" for c in carry), "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, timestamps array<bigint>, random_access array<bigint>"])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(materialize(media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet")), "op4-media"))
