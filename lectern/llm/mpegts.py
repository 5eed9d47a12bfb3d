"""MPEG transport streams as a media column (operator 1).

mux() stores a payload as one program of private data: a program association and a program map table before
each access unit, then the unit's packetised elementary stream (PES) packet with its time stamp, its first
transport packet marked as a random-access point with a clock reference. demux() reads any stream of 188-byte packets: it
parses the tables and checks their CRC, follows each elementary stream's continuity counters, drops
repeated packets, reassembles the PES packets and lists time stamps and random-access points.
"""

from __future__ import annotations

import dataclasses
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Batches, as_bytes, documents, record_batch, small_batches

# Fixed values of ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
NULL_PID = 0x1FFF
PRIVATE_STREAM_1 = 0xBD
PRIVATE_PES = 0x06  # stream type
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

# This module's own choices.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
FRAME = 192  # payloads are padded to a multiple of this
UNIT = 64 * FRAME  # payload bytes of an access unit
STEP = 3_600  # ticks between units, 25 a second
_HEAD = 14  # bytes of a PES header with one time stamp

UNIT_TYPE = T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("random_access", T.BooleanType())]))


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (CRC_POLYNOMIAL if value & 0x80000000 else 0)
        out.append(value & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for b in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ b]
    return value


def section(table_id: int, extension: int, body: bytes) -> bytes:
    """A long-form section, complete with its CRC."""
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


_PAT = section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def table_packet(pid: int, counter: int, content: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + content).ljust(PACKET, b"\xff")


def write_stamp(mark: int, stamp: int) -> bytes:
    return bytes([mark << 4 | (stamp >> 29) & 0x0E | 1, stamp >> 22 & 0xFF, (stamp >> 14) & 0xFE | 1, stamp >> 7 & 0xFF, (stamp << 1) & 0xFE | 1])


def read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def pes_packets(pes: bytes, counter: int, clock: int) -> bytes:
    """Transport packets of one PES packet: the first has the clock and the random-access mark, the last is stuffed."""
    room = PACKET - 12
    rest = max(0, len(pes) - room)
    n = 1 + -(-rest // (PACKET - 4))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    first = pes[:room]
    clock &= (1 << 33) - 1
    out[0, 4], out[0, 5] = PACKET - 5 - len(first), 0x50
    out[0, 6:12] = np.frombuffer(((clock << 15) | 0x7E00).to_bytes(6, "big"), np.uint8)
    out[0, PACKET - len(first) :] = np.frombuffer(first, np.uint8)
    if n > 1:
        full = n - 2
        body = np.frombuffer(pes, np.uint8, offset=room)
        out[1 : 1 + full, 4:] = body[: full * 184].reshape(full, 184)
        tail = body[full * 184 :]
        if len(tail) < 184:
            out[-1, 3] |= 0x20
            out[-1, 4] = 183 - len(tail)
            if len(tail) < 183:
                out[-1, 5] = 0
        out[-1, PACKET - len(tail) :] = tail
    return out.tobytes()


def mux_bytes(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream that holds the payload without loss."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        chunk, pts = payload[at : at + unit], (k * STEP) & ((1 << 33) - 1)
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + write_stamp(2, pts) + chunk
        packets = pes_packets(pes, counter, pts)
        out += [table_packet(PAT_PID, k, _PAT), table_packet(PMT_PID, k, _PMT), packets]
        counter += len(packets) // PACKET
    return b"".join(out)


@dataclasses.dataclass
class Stream:
    """What demux_bytes() found. payload: elementary bytes of all streams in order of pid."""

    programs: list[int] = dataclasses.field(default_factory=list)
    streams: list[tuple[int, int]] = dataclasses.field(default_factory=list)  # (pid, stream type)
    payload: bytes = b""
    units: list[tuple[int | None, int, int, bool]] = dataclasses.field(default_factory=list)  # (pts, offset, size, random access)
    packets: int = 0
    sync_errors: int = 0
    crc_errors: int = 0
    counter_errors: int = 0
    repeated: int = 0
    damaged_units: int = 0


def _sections(rows: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Sections of a table's packets, which may run over several packets."""
    out, open_ = [], b""

    def take(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < size:
                return data
            out.append(data[:size])
            data = data[size:]
        return b""

    for row, at in zip(rows, start, strict=True):
        if at >= PACKET:
            continue
        body = row[at:].tobytes()
        if row[1] & 0x40:
            pointer = body[0]
            if open_:
                take(open_ + body[1 : 1 + pointer])
            open_ = take(body[1 + pointer :])
        elif open_:
            open_ = take(open_ + body)
    return out


def demux_bytes(media: bytes) -> Stream:
    """Parses a transport stream; damage is counted, and what is whole is kept."""
    found = Stream(packets=len(media) // PACKET)
    rows = np.frombuffer(media, np.uint8, found.packets * PACKET).reshape(-1, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    found.sync_errors = int(len(rows) - good.sum()) + (len(media) % PACKET > 0)
    rows = rows[good]
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    control, counter = rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    start = np.where(control & 2, 5 + rows[:, 4].astype(np.int64), 4)
    start[control & 1 == 0] = PACKET
    start = np.minimum(start, PACKET)

    def valid(pids: int) -> list[bytes]:
        at = pid == pids
        parts = _sections(rows[at], start[at])
        whole = [s for s in parts if len(s) >= 12 and section_crc(s) == 0]
        found.crc_errors += len(parts) - len(whole)
        return list(dict.fromkeys(whole))

    maps = {}
    for s in valid(PAT_PID):
        for i in range(8, len(s) - 4, 4):
            number, where = s[i] << 8 | s[i + 1], (s[i + 2] & 0x1F) << 8 | s[i + 3]
            if number:
                maps[number] = where
    found.programs = sorted(maps)
    kinds: dict[int, int] = {}
    for number in found.programs:
        for s in valid(maps[number]):
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                kinds[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    found.streams = sorted(kinds.items())
    payload = []
    total = 0
    for p, _ in found.streams:
        at = np.flatnonzero((pid == p) & (control & 1 == 1))
        flags = np.where((control[at] & 2 > 0) & (rows[at, 4] > 0), rows[at, 5], 0)
        if len(at) > 1:
            jump = counter[at][1:].astype(np.int64) - counter[at][:-1] & 15
            same = np.zeros(len(at), bool)
            same[1:] = (jump == 0) & (rows[at[1:]] == rows[at[:-1]]).all(axis=1)
            found.repeated += int(same.sum())
            found.counter_errors += int(((jump != 1) & ~same[1:] & (flags[1:] & 0x80 == 0)).sum())
            at, flags = at[~same], flags[~same]
        begins = np.flatnonzero(rows[at, 1] & 0x40)
        sizes = PACKET - start[at]
        keep = np.arange(PACKET) >= start[at][:, None]
        data = rows[at][keep].tobytes()
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for n, b in enumerate(begins):
            e = begins[n + 1] if n + 1 < len(begins) else len(at)
            pes = data[edges[b] : edges[e]]
            if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
                found.damaged_units += 1
                continue
            length = pes[4] << 8 | pes[5]
            pts = read_stamp(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
            body = pes[9 + pes[8] : 6 + length if length else None]
            found.damaged_units += bool(length) and len(pes) < 6 + length
            payload.append(body)
            found.units.append((pts, total, len(body), bool(flags[b] & 0x40)))
            total += len(body)
    found.payload = b"".join(payload)
    return found


def mux(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with blanks to a positive multiple of `frame`, as a transport stream.

    Null and empty texts give one frame of blanks. Repeated rows stay, null ids stay null, other columns are ignored.
    """
    small_batches(df.sparkSession)
    source = documents(df, id_col, text_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            media = [mux_bytes(t.ljust(max(1, -(-len(t) // frame)) * frame, b" "), unit) for t in texts]
            whole = pa.schema([batch.schema.field(0), ("n_bytes", pa.int64()), ("media", pa.binary())])
            yield record_batch(whole, [batch.column(0), [len(t) for t in texts], media])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


_PARSED = [
    ("payload", pa.binary(), T.BinaryType()),
    ("programs", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    ("stream_pids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    ("stream_types", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
    ("units", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())])), UNIT_TYPE),
    *((n, pa.int64(), T.LongType()) for n in ("packets", "sync_errors", "crc_errors", "counter_errors", "repeated", "damaged_units")),
]


def demux(df: DataFrame, *, media_col: str = "media") -> DataFrame:
    """All columns of df and those of _PARSED, read from the stored streams. A null stream counts as one without packets.

    Columns of df that have a name of _PARSED are replaced.
    """
    others = [c for c in df.columns if c not in {n for n, _, _ in _PARSED}]
    source = df.select(*[F.col(f"`{c}`") for c in others])
    at = others.index(media_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            parsed = [demux_bytes(m or b"") for m in as_bytes(batch.column(at))]
            columns = [[s.payload for s in parsed], [s.programs for s in parsed], [[p for p, _ in s.streams] for s in parsed], [[k for _, k in s.streams] for s in parsed], [[dict(zip(("pts", "offset", "size", "random_access"), u)) for u in s.units] for s in parsed]]
            columns += [[getattr(s, n) for s in parsed] for n, _, _ in _PARSED[5:]]
            whole = pa.schema([*batch.schema, *((n, a) for n, a, _ in _PARSED)])
            yield record_batch(whole, [*batch.columns, *columns])

    return source.mapInArrow(run, T.StructType([*source.schema, *(T.StructField(n, t) for n, _, t in _PARSED)]))


def digests(parsed: DataFrame) -> DataFrame:
    """The digest columns of what was read back. feature: tables, units, last time stamp, random-access points and errors."""
    spark_units = F.col("units")
    feature = F.format_string(
        "programs=%d;streams=%s;packets=%d;units=%d;last_pts=%d;random_access=%d;errors=%d",
        F.size("programs"),
        F.concat_ws(",", F.zip_with("stream_pids", "stream_types", lambda p, k: F.format_string("%d:%d", p, k))),
        "packets",
        F.size(spark_units),
        F.coalesce(F.array_max(F.transform(spark_units, lambda u: u["pts"])), F.lit(-1)),
        F.size(F.filter(spark_units, lambda u: u["random_access"])),
        F.col("sync_errors") + F.col("crc_errors") + F.col("counter_errors") + F.col("damaged_units"),
    )
    size = F.octet_length("payload")
    return parsed.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def expected(text: str | None) -> tuple[int, int, str, int]:
    """n_bytes, payload_bytes, payload_sha256 and tail_crc32 by the plain rule, for tests."""
    raw = (text or "").encode()
    payload = raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
