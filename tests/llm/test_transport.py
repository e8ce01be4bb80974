"""The transport-stream reader on packets made by hand, such as the writer never makes."""

import random
import struct

import pytest

from tramline.llm import demux, transport

SPS = b"\0\0\1"


def plain_crc(data):
    crc = 0xFFFFFFFF
    for bit in (byte >> k & 1 for byte in data for k in range(7, -1, -1)):
        crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 ^ bit else 0)) & 0xFFFFFFFF
    return crc


def packet(pid, counter, payload=b"", start=False, flags=None, clock=None, control=None):
    """One packet; stuffed by its adaptation field. flags: of that field (0x80 a discontinuity, 0x40 random access)."""
    field = b""
    if flags is not None or clock is not None:
        field = bytes([(flags or 0) | (0x10 if clock is not None else 0)]) + (struct.pack(">LH", clock // 300 >> 1, (clock // 300 & 1) << 15 | 0x7E00 | clock % 300) if clock is not None else b"")
    room = 184 - len(payload)
    if control is None:
        control = (2 if room else 0) | (1 if payload else 0)
    extra = b""
    if control & 2:
        field = field or (b"\0" if room > 1 else b"")
        extra = bytes([room - 1]) + field + b"\xff" * (room - 1 - len(field))
    made = struct.pack(">BHB", 0x47, start << 14 | pid, control << 4 | counter & 15) + extra + payload
    assert len(made) == 188
    return made


def section(kind, number, body, part=0, last=0, version=0, current=1):
    data = struct.pack(">BHHBBB", kind, 0xB000 | (len(body) + 9), number, 0xC0 | version << 1 | current, part, last) + body
    return data + struct.pack(">L", plain_crc(data))


def psi(pid, counter, *sections):
    """Sections in a row over as many packets as they take; the first begins at once."""
    data = b"\0" + b"".join(sections)
    parts = [data[i : i + 184].ljust(184, b"\xff") for i in range(0, len(data), 184)]
    return [packet(pid, counter + k, p, start=not k) for k, p in enumerate(parts)]


def pes(body, pts=None, dts=None, kind=0xE0, size=True):
    flags = (0x80 if pts is not None else 0) | (0x40 if dts is not None else 0)
    mark = lambda t, lead: bytes([lead << 4 | (t >> 30 & 7) << 1 | 1]) + struct.pack(">HH", (t >> 15 & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)
    times = (mark(pts, 2 + (dts is not None)) if pts is not None else b"") + (mark(dts, 1) if dts is not None else b"")
    header = b"" if kind in demux.PLAIN else bytes([0x80, flags, len(times) + 2]) + times + b"\xff\xff"
    return SPS + bytes([kind]) + struct.pack(">H", len(header + body) if size else 0) + header + body


def spread(pid, counter, data, **first):
    out, room = [], 184 - (2 if first.get("flags") is not None else 0) - (6 if first.get("clock") is not None else 0)
    while data:
        out.append(packet(pid, counter + len(out), data[:room], start=not out, **({} if out else first)))
        data, room = data[room:], 184
    return out


PAT = section(0, 1, struct.pack(">HHHHHH", 0, 0xE010, 1, 0xE020, 2, 0xE021))
PMT1 = section(2, 1, struct.pack(">HH", 0xE100, 0xF003) + b"\x0a\x01x" + struct.pack(">BHH", 0x1B, 0xE100, 0xF002) + b"ab" + struct.pack(">BHH", 0x0F, 0xE101, 0xF000))
PMT2 = section(2, 2, struct.pack(">HHBHH", 0xE200, 0xF000, 0x06, 0xE200, 0xF000))


def test_crc_table():
    rng = random.Random(1)
    assert all(demux.crc_mpeg(d) == plain_crc(d) for d in (rng.randbytes(n) for n in range(40)))


def test_several_programs_and_streams():
    """The network's entry comes first; streams are mixed, with and without decode times, clocks, lengths, and null packets between."""
    a, b, c = [bytes([k]) * n for k, n in ((1, 500), (2, 100), (3, 700))]
    video = spread(0x100, 4, pes(a, 90_000, 45_000, size=False), flags=0x40, clock=27_000_123) + spread(0x100, 7, pes(b, (1 << 33) - 1))
    audio, other = spread(0x101, 15, pes(b, kind=0xC0)), spread(0x200, 0, pes(c, kind=0xBF)) + spread(0x200, 4, pes(b"", kind=0xBE))
    null = [packet(0x1FFF, k * 7, b"\0" * 184) for k in range(3)]
    rest = [video[0], null[0], other[0], audio[0], *video[1:3], other[1], null[1], *video[3:], *other[2:], null[2]]
    found = demux.demux(b"".join(psi(0, 9, PAT) + psi(0x20, 0, PMT1) + psi(0x21, 3, PMT2) + rest))
    assert [(s.program, s.pid, s.kind) for s in found.streams] == [(1, 0x100, 0x1B), (1, 0x101, 0x0F), (2, 0x200, 0x06)]
    one, two, three = found.streams
    assert one.payload == a + b and one.sizes == [500, 100] and one.presented == [90_000, (1 << 33) - 1] and one.decoded == [45_000, (1 << 33) - 1] and one.random_access == [True, False]
    assert two.payload == b and two.presented == [None] and three.payload == c and three.sizes == [700]
    assert found.clocks == {0x100: [27_000_123]} and found.repeats == 0


def test_sections_over_packets_and_side_by_side():
    """A map of 90 streams in three packets; two programs' maps on one PID; a table in two sections; a table that is not in force yet."""
    many = struct.pack(">HH", 0xE100, 0xF000) + b"".join(struct.pack(">BHH", 6, 0xE300 | k, 0xF000) for k in range(90))
    pat = [section(0, 1, struct.pack(">HH", 1, 0xE020), 0, 1), section(0, 1, struct.pack(">HH", 2, 0xE020), 1, 1)]
    later = section(2, 1, struct.pack(">HHBHH", 0xE100, 0xF000, 6, 0xE777, 0xF000), version=1, current=0)
    maps = psi(0x20, 0, section(2, 1, many), PMT2, later)
    assert len(maps) == 3
    found = demux.demux(b"".join(psi(0, 0, *pat) + maps + spread(0x200, 0, pes(b"x"))))
    assert [s.pid for s in found.streams] == [0x300 | k for k in range(90)] + [0x200] and found.streams[-1].payload == b"x"
    with pytest.raises(ValueError, match="cut off"):
        demux.demux(b"".join(psi(0, 0, *pat) + maps[:2]))
    with pytest.raises(ValueError, match="lacks sections"):
        demux.demux(b"".join(psi(0, 0, pat[0]) + maps))
    with pytest.raises(ValueError, match="no table of program 2"):
        demux.demux(b"".join(psi(0, 0, *pat) + psi(0x20, 0, section(2, 1, many))))
    broken = bytearray(maps[1])
    broken[100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        demux.demux(b"".join(psi(0, 0, *pat) + [maps[0], bytes(broken), maps[2]]))


def test_a_pointer_ends_the_section_before():
    """A section begins in the middle of a packet whose first bytes end the one before."""
    first = section(2, 1, struct.pack(">HH", 0xE100, 0xF000) + b"".join(struct.pack(">BHH", 6, 0xE300 | k, 0xF000) for k in range(45)))
    head, tail = first[:183], first[183:]
    second = bytes([len(tail)]) + tail + PMT2
    maps = [packet(0x20, 0, b"\0" + head, start=True), packet(0x20, 1, second.ljust(184, b"\xff"), start=True)]
    pat = section(0, 1, struct.pack(">HHHH", 1, 0xE020, 2, 0xE020))
    assert len(demux.demux(b"".join(psi(0, 0, pat) + maps)).streams) == 46


HEAD = psi(0, 0, section(0, 1, struct.pack(">HH", 1, 0xE020))) + psi(0x20, 0, section(2, 1, struct.pack(">HHBHH", 0xE100, 0xF000, 6, 0xE100, 0xF000)))


def read(packets):
    return demux.demux(b"".join([*HEAD, *packets])).streams[0].payload


def test_continuity():
    body = bytes(range(256)) * 3
    p = spread(0x100, 14, pes(body))
    assert len(p) == 5 and read(p) == body
    # One repeat is legal, its clock may differ; a second is not, nor one with other bytes.
    assert read([p[0], p[0], *p[1:]]) == body and demux.demux(b"".join([*HEAD, p[0], p[0], *p[1:]])).repeats == 1
    for wrong in ([p[0], p[0], p[0], *p[1:]], [p[0], *p[2:]], [p[0], p[1][:-1] + b"\xee", *p[1:]], [p[0], p[2], p[1], *p[3:]]):
        with pytest.raises(ValueError, match="continuity"):
            read(wrong)
    # Packets without a payload leave the counter where it is; one that moves it is wrong.
    still, moved = packet(0x100, 14, clock=5), packet(0x100, 15, flags=0)
    assert read([p[0], still, still, *p[1:]]) == body
    with pytest.raises(ValueError, match="without a payload"):
        read([p[0], moved, *p[1:]])
    # A marked discontinuity may jump anywhere.
    jump = spread(0x100, 6, pes(b"new", 1), flags=0x80)
    assert read([*p, *jump]) == body + b"new"
    # Continuity counts on PIDs that no table names, too.
    stray = [packet(0x1AB, 0, b"\1" * 184), packet(0x1AB, 5, b"\1" * 184)]
    with pytest.raises(ValueError, match="PID 427"):
        read([*p, *stray])


def test_streams_joined_on_their_way_and_damage():
    assert read([packet(0x100, 3, b"tail of something".ljust(184)), *spread(0x100, 4, pes(b"whole"))]) == b"whole"
    for wrong, what in ((spread(0x100, 0, b"\0\0\2" + pes(b"x")[3:]), "damaged"), (spread(0x100, 0, pes(b"x")[:-1]), "length"), (spread(0x100, 0, SPS + b"\xe0\0\0\x80"), "header"), ([packet(0x100, 0, flags=0)[:4] + b"\xc8" + b"\0" * 183], "too long")):
        with pytest.raises(ValueError, match=what):
            read(wrong)
    with pytest.raises(ValueError, match="marked as damaged"):
        read([struct.pack(">BHB", 0x47, 0x8100, 0x10) + b"\0" * 184])
    with pytest.raises(ValueError, match="no table of programs"):
        demux.demux(b"")


def test_streams_of_a_column(spark):
    media = b"".join([*HEAD, *spread(0x100, 0, pes(b"one", 7, 5), flags=0x40, clock=600), *spread(0x100, 1, pes(b"two"))])
    table = spark.createDataFrame([("a", media, 1), ("b", None, 2), (None, transport.encode(b"own " * 4000), 3)], "pid string, media binary, program int")
    rows = {r["pid"]: r for r in transport.elementary_streams(table.withColumnRenamed("pid", "key"), "key").withColumnRenamed("pid", "stream_pid").withColumnRenamed("key", "pid").collect()}
    assert rows.keys() == {"a", None}
    a = rows["a"]
    assert (a["program"], a["stream_pid"], a["payload"], a["timestamps"], a["decode_times"], a["random_access"], a["clocks"]) == (1, 0x100, b"onetwo", [7, None], [5, None], [7], [600])
    assert rows[None]["payload"] == b"own " * 4000 and rows[None]["timestamps"] == [0, 3600]
    assert transport.elementary_streams(table.limit(0), "pid").count() == 0
