"""Ogg: pages with verified checksums, packets from lacing values, logical streams apart, timestamps from granule positions.

The reader takes any physical bitstream: multiplexed or chained logical streams, packets that span pages, damaged or missing pages. A page
counts only if its checksum holds; after a damaged one the reader goes on at the next capture pattern, and a packet that has lost
a part is dropped and counted. The writer stores bytes as 8-bit samples, dealt in blocks over two logical streams whose pages alternate.

Checksum: Ogg's CRC-32 is zlib's with bits in the other order and no inversion, so zlib computes it over the bytes with their bits
reversed (one table lookup each).

Defined cases: null or empty text is a payload of 192 spaces; equal texts give equal bytes, as serial numbers are fixed; a text of
any length is one physical stream; null ids and repeated rows pass through, and pages of equal streams and numbers are read in the order of
their bytes; an empty table gives an empty result; further columns are not read. Bytes that hold no page give no streams.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, texts

#: Fixed values of the format (RFC 3533).
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

#: The stored form's own header packet: magic, streams, this stream's number, samples a block, samples a second.
SAMPLES = struct.Struct("<8sBBII")
MAGIC = b"LLPCM8\x00\x01"
STREAMS, BLOCK, RATE, PAGE = 2, 3840, 8000, 32640

REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero."""
    register = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{register:032b}"[::-1], 2)


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def paged(serial: int, packets: list[tuple[bytes, int]], most: int = PAGE) -> Iterator[bytes]:
    """Pages of one logical stream. A packet is (bytes, granule position at its end); the first has a page of its own."""
    number, flags, lacing, body, granule, packet_open = 0, FIRST, bytearray(), bytearray(), NO_GRANULE, False
    for at, (data, position) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes((len(data) % 255,))
        done = 0
        while values:
            take = values[: 255 - len(lacing)]
            size = sum(take)
            lacing += take
            body += data[done : done + size]
            done, values = done + size, values[len(take) :]
            last = at == len(packets) - 1 and not values
            if not values:
                granule = position
            if values or last or at == 0 or len(body) >= most or len(lacing) == 255:
                yield page(flags | (LAST if last else 0), granule, serial, number, bytes(lacing), bytes(body))
                number, flags, granule = number + 1, CONTINUED if values else 0, NO_GRANULE
                lacing.clear()
                body.clear()


def store(payload: bytes, streams: int = STREAMS, block: int = BLOCK, rate: int = RATE) -> bytes:
    """The payload as 8-bit samples: block i goes to stream i mod ``streams``; granule positions count a stream's own samples."""
    lanes = []
    for lane in range(streams):
        packets, position = [(SAMPLES.pack(MAGIC, streams, lane, block, rate), 0)], 0
        for start in range(lane * block, len(payload), streams * block):
            data = payload[start : start + block]
            position += len(data)
            packets.append((data, position))
        lanes.append(list(paged(lane + 1, packets)))
    out = [lane[0] for lane in lanes]
    for turn in range(1, max(map(len, lanes))):
        out += [lane[turn] for lane in lanes if turn < len(lane)]
    return b"".join(out)


@dataclass
class Logical:
    """One logical stream as read: packets with the granule position at their end (None where the page gives none)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    lost: int = 0
    ended: bool = False
    _part: list[bytes] = field(default_factory=list)
    _open: bool = False
    _next: int | None = None

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if self._next is not None and number != self._next:
            self.gaps += 1
            self.lost += self._open
            self._part, self._open = [], False
        skip = bool(flags & CONTINUED) and not self._open
        if self._open and not flags & CONTINUED:
            self.lost += 1
            self._part, self._open = [], False
        self._next, self.pages, self.ended = number + 1, self.pages + 1, self.ended or bool(flags & LAST)
        done, last = 0, None
        for value, run in laced(lacing):
            data = body[done : done + run]
            done += run
            if value == 255:  # goes on in the next page
                self._part.append(data)
                self._open = not skip
                if skip:
                    self._part = []
            elif skip:
                skip = False
                self.lost += 1
            else:
                self._part.append(data)
                last = len(self.packets)
                self.packets.append(b"".join(self._part) if len(self._part) > 1 else data)
                self.granules.append(None)
                self._part, self._open = [], False
        if last is not None and granule != NO_GRANULE:
            self.granules[last] = granule


def laced(lacing: bytes) -> Iterator[tuple[int, int]]:
    """(last lacing value, bytes) of each packet or part of one in a page."""
    start = 0
    while start < len(lacing):
        stop = start
        while stop < len(lacing) and lacing[stop] == 255:
            stop += 1
        if stop == len(lacing):
            yield 255, 255 * (stop - start)
        else:
            yield lacing[stop], 255 * (stop - start) + lacing[stop]
        start = stop + 1


def demultiplex(media: bytes) -> tuple[list[Logical], int]:
    """The logical streams in order of appearance, and the number of damaged places passed over."""
    streams: dict[int, Logical] = {}
    chained: list[Logical] = []
    at, damaged = 0, 0
    while (at := media.find(CAPTURE, at)) >= 0:
        if at + 27 > len(media):
            damaged += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        size = sum(lacing)
        end = at + 27 + n + size
        whole = version == 0 and len(lacing) == n and end <= len(media)
        if not whole or ogg_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            damaged += 1
            at += 4
            continue
        if serial not in streams or flags & FIRST and streams[serial].ended:  # a chained stream may use a serial number again
            streams[serial] = Logical(serial)
            chained.append(streams[serial])
        streams[serial].add(flags, granule, number, lacing, media[end - size : end])
        at = end
    return chained, damaged


def timestamps(stream: Logical, rate: int) -> list[float]:
    """Seconds at each sample packet's end: the page's granule position, carried to its other packets by their sizes."""
    positions: list[int | None] = list(stream.granules)
    sizes = [len(p) for p in stream.packets]
    for i in range(len(positions) - 2, 0, -1):
        following = positions[i + 1]
        if positions[i] is None and following is not None:
            positions[i] = following - sizes[i + 1]
    for i in range(1, len(positions)):
        before = positions[i - 1]
        if positions[i] is None and before is not None:
            positions[i] = before + sizes[i]
    return [(p or 0) / rate for p in positions]


def restore(media: bytes) -> tuple[bytes, str]:
    """The payload and a description, both from the stored bytes alone."""
    streams, damaged = demultiplex(media)
    lanes: dict[int, tuple[Logical, int, int]] = {}
    count = 0
    for stream in streams:
        if stream.packets and len(stream.packets[0]) == SAMPLES.size and stream.packets[0].startswith(MAGIC):
            _, count, lane, block, rate = SAMPLES.unpack(stream.packets[0])
            lanes[lane] = (stream, block, rate)
    if damaged or not lanes or len(lanes) != count or any(s.gaps or s.lost or not s.ended for s, _, _ in lanes.values()):
        raise ValueError("the stored stream is damaged")
    blocks = [lanes[lane][0].packets[1:] for lane in range(count)]
    out = [lane[turn] for turn in range(max(map(len, blocks))) for lane in blocks if turn < len(lane)]
    ends = [timestamps(stream, rate)[-1] for stream, _, rate in lanes.values()]
    first = lanes[0]
    feature = f"ogg streams={count} pages={sum(s.pages for s in streams)} packets={sum(len(b) for b in blocks)} rate={first[2]} seconds={','.join(f'{e:.4f}' for e in ends)}"
    return b"".join(out), feature


def padded(text: bytes, unit: int = 192) -> bytes:
    return text + b" " * (-len(text) % unit if text else unit)


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, unpadded size and the Ogg bytes of each text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = texts(batch)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in own], pa.int64()), pa.array([store(padded(t)) for t in own], pa.binary())], names=["doc_id", "n_bytes", "media"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, STORED)


def read_back(media: DataFrame) -> DataFrame:
    """Features of the stored bytes and the checks of the payload in them."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for data in texts(batch, "media"):
                payload, feature = restore(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = [list(c) for c in zip(*rows, strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *names])

        return each

    return map_batches(media, make, READ, "media")


PACKETS = "id long, serial long, packet_no int, payload binary, end_granule long, stream_pages int, stream_gaps int, stream_lost int, damaged int"


def packets(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of any Ogg column: serial number, bytes, granule position at its end (null where no page gives it)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), texts(batch, "media"), strict=True):
                streams, damaged = demultiplex(data)
                rows += [(key, s.serial, i, p, s.granules[i], s.pages, s.gaps, s.lost, damaged) for s in streams for i, p in enumerate(s.packets)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            names = ["id", "serial", "packet_no", "payload", "end_granule", "stream_pages", "stream_gaps", "stream_lost", "damaged"]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        return each

    return map_batches(media.select(media[id_column].cast("long").alias("id"), media[column].alias("media")), make, PACKETS, "media")


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(documents(spark, sf_dir)))
