"""Ogg media column: payloads stored as packets of two multiplexed logical streams, and read back.

Reading checks every page checksum, reassembles packets from lacing values
(across pages), demultiplexes by serial number and derives packet times from
granule positions.  `write` makes such a file from 8-bit samples so that any
binary column can be stored losslessly.

Layout made here: packets of 576 samples alternate between two logical streams
("even" and "odd"); each stream starts with one header packet, a page holds at
most 80 packets, and a page's granule position is the sample index, in the
whole signal, at which its last finished packet ends.  -1 marks a page on which
no packet ends.

Defined cases: null or empty text gives one packet of padding; broken
checksums, missing pages, or a stream cut short raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.storage import with_fields

#: Samples in a packet, packets on a page, samples a second.
FRAME = 576
PAGE_PACKETS = 80
RATE = 8_000
SERIALS = (0x4E42_0000, 0x4E42_0001)
_HEADER = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The container's CRC (polynomial 0x04C11DB7, most significant bit first, start 0).

    It is the mirror image of zlib's CRC over mirrored bytes.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def lacing_of(length: int) -> bytes:
    """Segment sizes of a packet: 255s, then one below 255 that ends it."""
    return b"\xff" * (length // 255) + bytes([length % 255])


def stream_header(serial: int) -> bytes:
    return b"\x01nb-pcm8\x00" + struct.pack("<IIB", RATE, FRAME, SERIALS.index(serial))


def write(payload: bytes) -> bytes:
    """Container bytes of a payload whose length is a positive multiple of FRAME."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"payload of {len(payload)} bytes isn't a positive multiple of {FRAME}")
    packets = len(payload) // FRAME
    out = [_page(s, 0, _FIRST, 0, lacing_of(len(h := stream_header(s))), h) for s in SERIALS]
    lacing = lacing_of(FRAME)
    sequence = [1, 1]
    for at in range(0, packets, 2 * PAGE_PACKETS):
        for parity in (0, 1):
            chosen = range(at + parity, min(at + 2 * PAGE_PACKETS, packets), 2)
            last = _LAST if at + 2 * PAGE_PACKETS >= packets else 0
            if chosen:
                body = b"".join(payload[p * FRAME : (p + 1) * FRAME] for p in chosen)
                granule = (chosen[-1] + 1) * FRAME
            elif last:
                body, granule = b"", -1
            else:
                continue
            out.append(_page(SERIALS[parity], sequence[parity], last, granule, lacing * len(chosen), body))
            sequence[parity] += 1
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream: whole packets and the granule position known at each (-1: none)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    rest: list[bytes] = field(default_factory=list)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, sequence, flags, granule, lacing, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if len(data) - at < _HEADER.size:
            raise ValueError("page header cut short")
        magic, version, flags, granule, serial, sequence, crc, segments = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        body = at + _HEADER.size + segments
        lacing = data[at + _HEADER.size : body]
        end = body + sum(lacing)
        if end > len(data) or len(lacing) < segments:
            raise ValueError("page cut short")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at} is wrong")
        yield serial, sequence, flags, granule, lacing, data[body:end]
        at = end


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, with their packets put together again."""
    found: dict[int, Stream] = {}
    for serial, sequence, flags, granule, lacing, body in pages(data):
        stream = found.get(serial)
        if stream is None:
            if not flags & _FIRST:
                raise ValueError(f"stream {serial} doesn't begin with a first page")
            stream = found[serial] = Stream(serial)
        if sequence != stream.pages or stream.ended:
            raise ValueError(f"stream {serial}: page {sequence} where {stream.pages} belongs")
        if bool(flags & _CONTINUED) != bool(stream.rest):
            raise ValueError(f"stream {serial}: page {sequence} doesn't continue its packet")
        stream.pages += 1
        stream.ended = bool(flags & _LAST)
        start = here = 0
        for size in lacing:
            here += size
            if size < 255:
                stream.packets.append(b"".join([*stream.rest, body[start:here]]))
                stream.granules.append(-1)
                stream.rest, start = [], here
        if start < here:
            stream.rest.append(body[start:here])
        if granule >= 0 and any(s < 255 for s in lacing):
            stream.granules[-1] = granule
    for stream in found.values():
        if stream.rest or not stream.ended:
            raise ValueError(f"stream {stream.serial} is cut short")
    return found


def packet_ends(stream: Stream, frame: int = FRAME, streams: int = 2) -> list[int]:
    """Sample index at which each data packet ends, counted back from the granule position of its page."""
    ends = [0] * len(stream.packets)
    known = None
    for i in range(len(stream.packets) - 1, 0, -1):
        known = stream.granules[i] if stream.granules[i] >= 0 else None if known is None else known - frame * streams
        if known is None:
            raise ValueError(f"stream {stream.serial} has no granule position after packet {i}")
        ends[i] = known
    return ends[1:]


def read(data: bytes) -> tuple[bytes, dict[str, float]]:
    """(payload, figures): packets of all streams in the order of their times."""
    streams = demultiplex(data)
    timed = []
    for stream in streams.values():
        if stream.packets[0] != stream_header(stream.serial):
            raise ValueError(f"stream {stream.serial} has no header of this kind")
        timed += zip(packet_ends(stream), stream.packets[1:], strict=True)
    timed.sort()
    at = 0
    for end, packet in timed:
        at += len(packet)
        if end != at:
            raise ValueError(f"a packet ends at sample {end} where {at} is due")
    return b"".join(p for _, p in timed), {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(timed), "seconds": at / RATE}


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


def feature(samples: bytes, figures: dict[str, float]) -> str:
    """Container figures, then mean, deviation and zero crossings of the samples about 128."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    mean = float((counts * levels).sum() / len(x))
    deviation = float(np.sqrt(max((counts * levels**2).sum() / len(x) - mean**2, 0)))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"streams={figures['streams']};pages={figures['pages']};packets={figures['packets']};seconds={figures['seconds']:.3f};mean={mean:.4f};std={deviation:.4f};crossings={crossings}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with the text's bytes as a media column (binary, lossless); a column of that name is replaced."""
    kept = df.drop(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [write(padded((t or "").encode())) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, media])

    return kept.mapInArrow(run, with_fields(kept, (media, "binary")))


def packets(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row a packet: key, serial, number in its stream, end time in seconds, bytes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                rows = [(s.serial, i, e / RATE, p) for s in demultiplex(data).values() for i, (e, p) in enumerate(zip(packet_ends(s), s.packets[1:], strict=True))]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.schema.field(0).type), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.binary())], names=["key", "serial", "packet", "end_s", "data"])

    return df.select(key, media).mapInArrow(run, f"key {kind}, serial long, packet long, end_s double, data binary").withColumnRenamed("key", key)


def digest(docs: DataFrame) -> DataFrame:
    """Stores each document as media, reads the stored bytes back, and returns the digests named in SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    media = write(padded(raw))
                    back, figures = read(media)
                    rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, figures)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
