"""MPEG transport streams as a media column.

A payload is cut into access units, each a PES packet with a presentation time; every ``RAP_EVERY``-th is a
random-access point: the program tables come before it, and its first packet has the random-access flag and the
clock reference. The column keeps, beside the stream, the units' timestamps and the byte offsets of the points,
so a reader may start at any of them. Reading parses the tables (their CRCs must hold), checks each PID's
continuity counter, and joins the elementary stream's packets; what is lost or cut short is counted and never
passed on as whole.

Null and empty texts have a payload of 64 zero bytes. Repeated rows are stored each; equal texts have equal
streams. A row is worked on by itself, so memory follows the longest text.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of_batches, written

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: ISO/IEC 13818-1: PES packets of private data.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT_BYTES = 16 << 10
RAP_EVERY = 8
#: 90 kHz clock at 25 units a second.
PTS_STEP = 3600
PAD_TO = 64

_MEDIA = "doc_id bigint, n_bytes bigint, media binary, pts array<bigint>, points array<bigint>"
_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


@functools.lru_cache(64)
def _crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + _crc32_mpeg(head + body).to_bytes(4, "big")


@functools.lru_cache(1)
def _tables() -> dict[int, bytes]:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return {PAT_PID: pat, PMT_PID: pmt}


def _pts_bytes(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _pts_of(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _table_packet(pid: int, counter: int) -> np.ndarray:
    out = np.full(PACKET, 0xFF, np.uint8)
    section = _tables()[pid]
    out[:5] = SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0
    out[5 : 5 + len(section)] = np.frombuffer(section, np.uint8)
    return out


def _unit_packets(unit: np.ndarray, pts: int, counter: int, point: bool) -> np.ndarray:
    head = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts)
    data = np.concatenate([np.frombuffer(head, np.uint8), unit])
    first = 176 if point else 184
    n = 1 + -(-max(0, len(data) - first) // 184)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    if point:
        # the clock reference: 33 bits of 90 kHz, 6 reserved, 9 of 27 MHz
        clock = (pts & (1 << 33) - 1) << 15 | 0x3F << 9
        out[0, 3] |= 0x20
        out[0, 4:12] = np.frombuffer(bytes([7, 0x50]) + clock.to_bytes(6, "big"), np.uint8)
    at = min(first, len(data))
    if n > 2:
        out[1:-1, 4:] = data[at : at + 184 * (n - 2)].reshape(n - 2, 184)
    if n > 1:
        out[0, PACKET - first :] = data[:first]
        rest = data[at + 184 * (n - 2) :]
    else:
        rest = data
    out[-1, PACKET - len(rest) :] = rest
    room = 184 - len(rest)
    last = out[-1]
    if n == 1 and point:
        last[4] = room - 1
    elif room:
        last[3] |= 0x20
        last[4] = room - 1
        if room > 1:
            last[5] = 0
    return out


def mux(payload: bytes) -> tuple[bytes, list[int], list[int]]:
    """(stream, timestamps, byte offsets of the random-access points)."""
    data, out, pts, points, packets = np.frombuffer(payload, np.uint8), [], [], [], 0
    counter = tables = 0
    for k, at in enumerate(range(0, len(data), UNIT_BYTES)):
        point = k % RAP_EVERY == 0
        if point:
            points.append(packets * PACKET)
            out += [_table_packet(pid, tables)[None] for pid in (PAT_PID, PMT_PID)]
            tables, packets = tables + 1, packets + 2
        unit = _unit_packets(data[at : at + UNIT_BYTES], k * PTS_STEP, counter, point)
        counter, packets = counter + len(unit), packets + len(unit)
        pts.append(k * PTS_STEP)
        out.append(unit)
    return np.concatenate(out).tobytes(), pts, points


@dataclass
class Demuxed:
    payload: bytes = b""
    packets: int = 0
    pids: list[int] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    points: list[int] = field(default_factory=list)
    #: Breaks of a continuity counter; bytes and packets that no whole unit could be made of.
    breaks: int = 0
    damaged: int = 0


def _table_body(packet: np.ndarray, table_id: int) -> bytes | None:
    start = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    if start >= PACKET - 8:
        return None
    section = packet[start + 1 + int(packet[start]) :].tobytes()
    size = 3 + (int.from_bytes(section[1:3], "big") & 0x0FFF)
    if section[0] != table_id or size > len(section) or _crc32_mpeg(section[: size - 4]) != int.from_bytes(section[size - 4 : size], "big"):
        return None
    return section[8 : size - 4]


def demux(media: bytes, start: int = 0) -> Demuxed:
    """Read a stream from byte ``start``, 0 or one of its random-access points."""
    rows = np.frombuffer(media, np.uint8)[start:]
    rows = rows[: len(rows) // PACKET * PACKET].reshape(-1, PACKET)
    out = Demuxed(packets=len(rows))
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    out.damaged += int((~good).sum())
    at_packet, rows = np.flatnonzero(good), rows[good]
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    begins = rows[:, 1] & 0x40 != 0
    control = rows[:, 3] >> 4 & 3

    programs: dict[int, int] = {}
    for k in np.flatnonzero((pid == PAT_PID) & begins):
        body = _table_body(rows[k], 0x00)
        out.damaged += body is None
        for at in range(0, len(body or b""), 4):
            if number := int.from_bytes(body[at : at + 2], "big"):
                programs[number] = int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    streams: dict[int, int] = {}
    for k in np.flatnonzero(np.isin(pid, list(programs.values())) & begins):
        body = _table_body(rows[k], 0x02)
        out.damaged += body is None
        at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF) if body else 0
        while body and at + 5 <= len(body):
            streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
            at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0x0FFF)
    out.pids = sorted(streams)

    broken = np.zeros(len(rows), bool)
    for p in np.unique(pid):
        mine = np.flatnonzero((pid == p) & (control & 1 == 1))
        counter = rows[mine, 3] & 15
        jump = np.flatnonzero((counter[1:] - counter[:-1] & 15) != 1) + 1
        broken[mine[jump]] = True
    out.breaks = int(broken.sum())

    parts = []
    for p in out.pids:
        mine = np.flatnonzero((pid == p) & (control & 1 == 1))
        own = rows[mine]
        begin = np.where(control[mine] & 2 != 0, 5 + own[:, 4].astype(np.int32), 4)
        flags = np.where((control[mine] & 2 != 0) & (own[:, 4] > 0), own[:, 5], 0)
        body = own[np.arange(PACKET) >= begin[:, None]]
        ends = np.concatenate([[0], np.cumsum(np.maximum(0, PACKET - begin))])
        heads = np.flatnonzero(begins[mine])
        out.damaged += int(heads[0]) if len(heads) else len(mine)
        for k, nxt in zip(heads, [*heads[1:], len(mine)], strict=True):
            unit = body[ends[k] : ends[nxt]]
            size = 6 + (int(unit[4]) << 8 | int(unit[5])) if len(unit) >= 14 else 0
            if not size or bytes(unit[:3]) != b"\x00\x00\x01" or size > len(unit) or broken[mine[k + 1 : nxt]].any():
                out.damaged += int(nxt - k)
                continue
            if unit[7] & 0x80:
                out.pts.append(_pts_of(bytes(unit[9:14])))
            if flags[k] & 0x40:
                out.points.append(start + int(at_packet[mine[k]]) * PACKET)
            parts.append(unit[9 + int(unit[8]) : size])
    out.payload = np.concatenate(parts).tobytes() if parts else b""
    return out


def _padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data.ljust(max(PAD_TO, -(-len(data) // PAD_TO) * PAD_TO), b"\x00")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in pieces_of_batches(batches, "text", 8 << 20):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            size, payload = _padded(text)
            rows.append((doc_id, size, *mux(payload)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "media", "pts", "points"]
        )


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, pts, points: each text of ``docs`` (doc_id, text) as a transport stream."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored, _MEDIA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    kinds = [pa.string() if x.endswith(" string") else pa.int64() for x in _FEATURES.split(", ")]
    for batch in pieces_of_batches(batches, "media", 8 << 20):
        rows = []
        for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = demux(media)
            feature = (
                f"streams={','.join(map(str, got.pids))};packets={got.packets};units={len(got.pts)};points={len(got.points)};"
                f"pts={min(got.pts, default=-1)}..{max(got.pts, default=-1)};breaks={got.breaks};damaged={got.damaged}"
            )
            rows.append((
                doc_id, n_bytes, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-PAD_TO:]) & 0xFFFFFFFF,
                len(media), hashlib.sha256(media).hexdigest(), feature,
            ))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def features(media: DataFrame) -> DataFrame:
    """What reading each stream of ``media`` (doc_id, n_bytes, media) gives: sizes, digests and a line of figures."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, _FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back and compute their features."""
    return features(written(store(docs), "media"))
