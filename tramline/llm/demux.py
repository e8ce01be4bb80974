"""Reading MPEG transport streams, whoever wrote them.

Programs are found through the association table (entry 0, the network's, is none of
them) and the map table of each; tables are put together from sections, which may
span packets or share one, and must have a right checksum. Continuity is checked on
every PID but that of null packets: a counter goes on with each packet that has a
payload and stands still with one that has none; one repeat of a packet is legal and
counts once; where a packet marks a discontinuity the counter may jump. Elementary
packets are reassembled from packet to packet, with their timestamps and random-access
points; packets of unknown length last until the next one starts. What comes before the
first start of a PID (a stream that was joined on its way) is left out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the transport stream standard.
PACKET, SYNC, PAT_PID, NULL_PID, PAT_TABLE, PMT_TABLE = 188, 0x47, 0, 0x1FFF, 0, 2
#: Streams whose packets have no header beyond their length: map, padding, private 2, key messages, commands, type E and directory.
PLAIN = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))
CRC_TABLE = np.zeros(256, np.int64)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    CRC_TABLE[_i] = _c
_CRC = CRC_TABLE.tolist()


def crc_mpeg(data: bytes) -> int:
    """CRC-32 as tables carry it: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


@dataclass
class Elementary:
    """One stream of a program: its elementary packets' data in a row, and for each packet its size, times (or None) and whether it is a random-access point."""

    program: int
    pid: int
    kind: int
    payload: bytes = b""
    sizes: list[int] = field(default_factory=list)
    presented: list[int | None] = field(default_factory=list)
    decoded: list[int | None] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)


@dataclass
class Multiplex:
    streams: list[Elementary]
    #: Clock references by PID, in 27 MHz.
    clocks: dict[int, list[int]]
    packets: int
    repeats: int


class Packets:
    """A stream's packets in columns."""

    def __init__(self, media: bytes):
        if len(media) % PACKET:
            raise ValueError("not a whole number of transport packets")
        rows = self.rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (rows[:, 0] != SYNC).any():
            raise ValueError("lost synchronisation")
        if (rows[:, 1] & 0x80).any():
            raise ValueError("a packet is marked as damaged")
        self.pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
        self.start, self.counter = rows[:, 1] & 0x40 > 0, rows[:, 3].astype(np.int32) & 15
        self.extra, self.full = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
        size = np.where(self.extra, rows[:, 4].astype(np.int32), 0)
        flags = np.where(size > 0, rows[:, 5], 0)
        self.jump, self.random, self.clocked = flags & 0x80 > 0, flags & 0x40 > 0, (flags & 0x10 > 0) & (size > 6)
        self.offset = np.where(self.full, 4 + self.extra + size, PACKET)
        if (self.offset > PACKET).any() or (4 + self.extra + size > PACKET).any():
            raise ValueError("an adaptation field is too long")

    def kept(self, pid: int) -> tuple[np.ndarray, int]:
        """Numbers of a PID's packets that have a payload, without repeats, and the number of repeats."""
        at = np.nonzero(self.pid == pid)[0]
        full, counter, jump = self.full[at], self.counter[at], self.jump[at]
        if full.all() and len(at) > 1 and not jump.any() and ((np.diff(counter) & 15) == 1).all():
            return at, 0
        kept: list[int] = []
        last, again = None, False
        for k, n in enumerate(at.tolist()):
            if last is None or jump[k]:
                pass
            elif not full[k]:
                if counter[k] != last:
                    raise ValueError(f"the continuity counter of PID {pid} moves without a payload")
            elif counter[k] == last and kept and not again and self._same(n, kept[-1]):
                again = True
                continue
            elif counter[k] != last + 1 & 15:
                raise ValueError(f"the continuity counter of PID {pid} jumps: packets are missing or repeated")
            if full[k]:
                kept.append(n)
                again = False
            last = int(counter[k])
        return np.array(kept, np.int64), int(full.sum()) - len(kept)

    def _same(self, a: int, b: int) -> bool:
        """Whether a packet repeats another: the same payload (the clock reference may differ)."""
        return self.offset[a] == self.offset[b] and bool((self.rows[a, self.offset[a] :] == self.rows[b, self.offset[b] :]).all())

    def data(self, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payloads of packets in a row, and where each begins."""
        rows, offset = self.rows[at], self.offset[at]
        sizes = PACKET - offset
        return rows[np.arange(PACKET) >= offset[:, None]].tobytes(), np.cumsum(sizes) - sizes


def sections(packets: Packets, at: np.ndarray) -> list[bytes]:
    """The whole sections of a PID, checksums checked; a section may begin in one packet and end in another."""
    found, held, open_ = [], b"", False
    raw, begins = packets.data(at)
    for k, n in enumerate(at.tolist()):
        part = raw[begins[k] : begins[k + 1] if k + 1 < len(begins) else len(raw)]
        pieces = [(part, False)]
        if packets.start[n]:
            if not part or part[0] >= len(part):
                raise ValueError("a pointer leads out of its packet")
            pieces = [(part[1 : 1 + part[0]], False), (part[1 + part[0] :], True)]
        for piece, fresh in pieces:
            if fresh:
                if open_ and held:
                    raise ValueError("a section is cut off")
                held, open_ = b"", True
            if not open_:
                continue
            held += piece
            while len(held) >= 3 and held[0] != 0xFF:
                size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0x0FFF)
                if len(held) < size:
                    break
                if crc_mpeg(held[:size]):
                    raise ValueError("a table is damaged")
                found.append(held[:size])
                held = held[size:]
            if held[:1] == b"\xff":
                held, open_ = b"", False
    if held:
        raise ValueError("a section is cut off")
    return found


def table(packets: Packets, pid: int, kind: int, counted: dict[int, int]) -> dict[int, bytes]:
    """{number of the table (program or stream): its sections' bodies in a row} of the last version in force."""
    at, counted[pid] = packets.kept(pid)
    parts: dict[int, dict[int, bytes]] = {}
    versions: dict[int, tuple[int, int]] = {}
    for s in sections(packets, at):
        if s[0] != kind:
            continue
        number, state, k, last = struct.unpack_from(">HBBB", s, 3)
        if not state & 1:
            continue
        if versions.get(number) != (state, last):
            versions[number], parts[number] = (state, last), {}
        parts[number][k] = s[8:-4]
    for number, (_, last) in versions.items():
        if parts[number].keys() != set(range(last + 1)):
            raise ValueError(f"a table on PID {pid} lacks sections")
    return {number: b"".join(parts[number][k] for k in sorted(parts[number])) for number in parts}


def moment(data: bytes) -> int:
    x, y, z = struct.unpack_from(">BHH", data)
    return (x >> 1 & 7) << 30 | (y >> 1) << 15 | z >> 1


def reassembled(packets: Packets, at: np.ndarray, out: Elementary) -> None:
    """Fills out with the elementary packets of a PID."""
    raw, begins = packets.data(at)
    first = np.nonzero(packets.start[at])[0]
    parts, ends = [], [*begins[first[1:]].tolist(), len(raw)] if len(first) else []
    for k, end in zip(first.tolist(), ends, strict=True):
        data = raw[int(begins[k]) : end]
        if len(data) < 6 or data[:3] != b"\0\0\1":
            raise ValueError("an elementary packet is damaged")
        size = struct.unpack_from(">H", data, 4)[0]
        if size and size != len(data) - 6:
            raise ValueError("an elementary packet is damaged: its length differs")
        shown = decoded = None
        body = data[6:]
        if data[3] not in PLAIN:
            if len(data) < 9 or len(data) < 9 + data[8] or data[6] >> 6 != 2:
                raise ValueError("an elementary packet is damaged: its header is cut off")
            if data[7] & 0x80:
                shown = decoded = moment(data[9:14])
            if data[7] & 0xC0 == 0xC0:
                decoded = moment(data[14:19])
            body = data[9 + data[8] :]
        if data[3] == 0xBE:
            continue
        parts.append(body)
        out.sizes.append(len(body))
        out.presented.append(shown)
        out.decoded.append(decoded)
        out.random_access.append(bool(packets.random[at[k]]))
    out.payload = b"".join(parts)


def clocks(packets: Packets) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for n in np.nonzero(packets.clocked)[0].tolist():
        high, low = struct.unpack(">LH", packets.rows[n, 6:12].tobytes())
        found.setdefault(int(packets.pid[n]), []).append((high << 1 | low >> 15) * 300 + (low & 0x1FF))
    return found


def demux(media: bytes) -> Multiplex:
    """All elementary streams of all programs, by program and in the order of their map tables."""
    packets, counted, streams = Packets(media), {}, []
    association = table(packets, PAT_PID, PAT_TABLE, counted)
    if not association:
        raise ValueError("no table of programs")
    maps = {number: pid & 0x1FFF for body in association.values() for number, pid in struct.iter_unpack(">HH", body) if number}
    read: dict[int, dict[int, bytes]] = {}
    for program, pid in sorted(maps.items()):
        if pid not in read:
            read[pid] = table(packets, pid, PMT_TABLE, counted)
        if program not in read[pid]:
            raise ValueError(f"no table of program {program}")
        body = read[pid][program]
        at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF)
        while at + 5 <= len(body):
            kind, place, size = struct.unpack_from(">BHH", body, at)
            at += 5 + (size & 0x0FFF)
            streams.append(Elementary(program, place & 0x1FFF, kind))
    done: dict[int, Elementary] = {}
    for s in streams:
        if s.pid not in done:
            kept, counted[s.pid] = packets.kept(s.pid)
            reassembled(packets, kept, s)
            done[s.pid] = s
        elif s is not done[s.pid]:
            # Programs may share a stream.
            same = done[s.pid]
            s.payload, s.sizes, s.presented, s.decoded, s.random_access = same.payload, same.sizes, same.presented, same.decoded, same.random_access
    for pid in np.unique(packets.pid).tolist():
        if pid not in counted and pid != NULL_PID:
            counted[pid] = packets.kept(pid)[1]
    return Multiplex(streams, clocks(packets), len(packets.rows), sum(counted.values()))
