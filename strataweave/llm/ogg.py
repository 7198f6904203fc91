"""Ogg media columns: page checksums, packets from lacing values, logical streams and timestamps from granule positions.

The page format is that of RFC 3533.  `mux` writes streams, `demux_chain` reads any physical stream: it checks every
page, splits the streams by serial number, rebuilds packets across pages, and starts a new link of a chain where streams
begin after all others have ended.  A page's granule position is the end of the last packet that ends on it; `times`
derives each page's time from it, and each packet's by going back from it by what the packets hold, as players do.
`store` and `load` keep a byte payload losslessly as unsigned 8-bit samples beside a cue stream, in one multiplexed file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

# Fixed values of the format
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
NO_GRANULE = -1

RATE = 8000
PACKET = 4080  # samples: sixteen whole lacing values
PCM_MAGIC, CUE_MAGIC = b"PCM8", b"CUES"
PCM_SERIAL, CUE_SERIAL = 1, 2

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0 and without a final complement.

    zlib's CRC is the same division with bits in the other order: flipping the bits of each byte before and of the
    register after gives this one, at zlib's speed.
    """
    register = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_FLIP), "big")


class OggError(ValueError):
    """What is wrong with a physical stream, and at which byte."""


@dataclass
class Packet:
    data: bytes
    granule: int  # of the page on which it ends if it is the last to end there, else NO_GRANULE


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    last_granule: int = 0
    ended: bool = False
    partial: list[bytes] = field(default_factory=list)
    next_page: int = 0
    page_granules: list[int] = field(default_factory=list)
    page_ends: list[int] = field(default_factory=list)  # how many packets have ended up to each page's end


def pages_of(serial: int, packets: list[tuple[bytes, int]], per_page: int = 4) -> Iterator[tuple[int, bytes]]:
    """(granule, page) for each page of one stream; packets are (data, granule at their end), the first alone on its page."""
    sequence, at, n = 0, 0, len(packets)
    lacing, body, granule, continued, ended = bytearray(), [], NO_GRANULE, False, 0

    def page(last: bool) -> bytes:
        kind = CONTINUED * continued | FIRST * (sequence == 0) | LAST * last
        raw = HEADER.pack(CAPTURE, 0, kind, granule, serial, sequence, 0, len(lacing)) + bytes(lacing) + b"".join(body)
        return raw[:22] + struct.pack("<I", page_checksum(raw)) + raw[26:]

    while at < n:
        data, position = packets[at]
        values = [255] * (len(data) // 255) + [len(data) % 255]
        done = 0
        for i, value in enumerate(values):
            if len(lacing) == 255:
                yield granule, page(False)
                sequence, continued, granule, ended = sequence + 1, i > 0, NO_GRANULE, 0
                lacing, body = bytearray(), []
            lacing.append(value)
            body.append(data[done : done + value])
            done += value
        granule, ended, at = position, ended + 1, at + 1
        if at == n or sequence == 0 or ended == per_page:
            yield granule, page(at == n)
            sequence, continued, granule, ended = sequence + 1, False, NO_GRANULE, 0
            lacing, body = bytearray(), []


def mux(streams: dict[int, list[tuple[bytes, int]]], order: dict[int, float] | None = None) -> bytes:
    """One physical stream: first pages first, then pages by time (granule over order, a stream's granules a second)."""
    rate = order or dict.fromkeys(streams, 1.0)
    queued = []
    for serial, packets in streams.items():
        time = 0.0
        for i, (granule, page) in enumerate(pages_of(serial, packets)):
            time = max(time, granule / rate[serial]) if granule >= 0 else time
            queued.append((i > 0, time, serial, i, page))
    return b"".join(x[-1] for x in sorted(queued, key=lambda x: x[:4]))


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, of a physical stream that isn't a chain.  Raises OggError like demux_chain."""
    links = demux_chain(data)
    if len(links) > 1:
        raise OggError(f"a chain of {len(links)} links")
    return links[0] if links else {}


def demux_chain(data: bytes) -> list[dict[int, Stream]]:
    """The links of a physical stream, each its logical streams by serial number; a later link may use a serial again.

    Raises OggError on a wrong capture, checksum, sequence or truncation.
    """
    streams: dict[int, Stream] = {}
    links = [streams]
    at, size = 0, len(data)
    while at < size:
        if size - at < HEADER.size:
            raise OggError(f"truncated page header at byte {at}")
        capture, version, kind, granule, serial, sequence, checksum, n = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        body_at = at + HEADER.size + n
        end = body_at + sum(lacing)
        if len(lacing) < n or end > size:
            raise OggError(f"truncated page at byte {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != checksum:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if kind & FIRST:
            # first pages of one link stand together, so others between them, or a serial's return, begin the next
            if (serial in streams or any(x.pages > 1 for x in streams.values())) and all(x.ended for x in streams.values()):
                streams = {}
                links.append(streams)
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        stream = streams.get(serial)
        if stream is None or stream.ended:
            raise OggError(f"page of stream {serial} outside it at byte {at}")
        if sequence != stream.next_page:
            raise OggError(f"stream {serial} lacks page {stream.next_page}")
        if bool(kind & CONTINUED) != bool(stream.partial):
            raise OggError(f"broken packet in stream {serial} at byte {at}")
        stream.next_page, stream.pages = sequence + 1, stream.pages + 1
        ends_here, begin, run = [], body_at, 0
        for value in lacing:
            run += value
            if value < 255:
                stream.partial.append(data[begin : begin + run])
                ends_here.append(Packet(b"".join(stream.partial), NO_GRANULE))
                stream.partial, begin, run = [], begin + run, 0
        if n and lacing[-1] == 255:
            stream.partial.append(data[begin : begin + run])
        if ends_here:
            ends_here[-1].granule = granule
            stream.last_granule = max(stream.last_granule, granule)
        stream.packets += ends_here
        stream.page_granules.append(granule)
        stream.page_ends.append(len(stream.packets))
        stream.ended = bool(kind & LAST)
        at = end
    for stream in (x for link in links for x in link.values()):
        if stream.partial or not stream.ended:
            raise OggError(f"stream {stream.serial} has no end")
    return links if links[0] else []


def times(stream: Stream, rate: int, held: Callable[[bytes], int], start: int = 0) -> tuple[list[int | None], list[int]]:
    """Microseconds at which each page and each packet ends, counted from start (of a chain's later link, its beginning).

    held: granules in a packet.  A page on which no packet ends has no time.  Packets after the last granule position,
    which a whole stream doesn't have, go forward from it.
    """
    ends, done, now = [0] * len(stream.packets), 0, 0
    for granule, upto in zip(stream.page_granules, stream.page_ends, strict=True):
        if upto > done:
            now = granule if granule != NO_GRANULE else now + sum(held(p.data) for p in stream.packets[done:upto])
            back = now
            for i in range(upto - 1, done - 1, -1):
                ends[i] = back
                back -= held(stream.packets[i].data)
            done = upto
    pages = [None if g == NO_GRANULE else start + g * 1_000_000 // rate for g in stream.page_granules]
    return pages, [start + g * 1_000_000 // rate for g in ends]


def pad(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def store(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """payload as samples of one stream; the other has the payload's own length and a cue each second."""
    samples = [(PCM_MAGIC + struct.pack("<II", rate, 1), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    cues = [(CUE_MAGIC + struct.pack("<QQ", n_bytes, len(payload)), 0)]
    cues += [(struct.pack("<Q", i), i) for i in range(rate, len(payload), rate)]
    return mux({PCM_SERIAL: samples, CUE_SERIAL: cues}, {PCM_SERIAL: rate, CUE_SERIAL: rate})


def load(media: bytes) -> tuple[bytes, int, dict[int, Stream], int]:
    """payload, the length without padding, the streams and the sample rate of what store wrote."""
    streams = demux(media)
    by_magic = {s.packets[0].data[:4]: s for s in streams.values() if s.packets}
    pcm, cue = by_magic.get(PCM_MAGIC), by_magic.get(CUE_MAGIC)
    if pcm is None or cue is None:
        raise OggError("a stream is missing")
    rate, _ = struct.unpack_from("<II", pcm.packets[0].data, 4)
    n_bytes, whole = struct.unpack_from("<QQ", cue.packets[0].data, 4)
    payload = b"".join(p.data for p in pcm.packets[1:])
    if len(payload) != whole or pcm.last_granule != whole:
        raise OggError("samples and granule positions differ")
    return payload, n_bytes, streams, rate


def samples_in(packet: bytes) -> int:
    """Granules of a packet of the samples' stream; its header has none."""
    return 0 if packet[:4] == PCM_MAGIC and len(packet) == 12 else len(packet)


def feature(payload: bytes, streams: dict[int, Stream], rate: int) -> str:
    """Duration of the samples' stream, a checksum of its pages' and packets' times, numbers of packets, pages and cues,
    mean and variance of the samples, and crossings of the middle."""
    x = np.frombuffer(payload, dtype=np.uint8)
    level = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    pcm, cue = streams[PCM_SERIAL], streams[CUE_SERIAL]
    pages, packets = times(pcm, rate, samples_in)
    timed = zlib.crc32(struct.pack(f"<{len(pages) + len(packets)}q", *(-1 if x is None else x for x in pages), *packets))
    total, squares = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.float64), x.astype(np.float64)))
    mean = total / len(x)
    return f"us={packets[-1]};times={timed:08x};packets={len(pcm.packets)};pages={pcm.pages};cues={len(cue.packets) - 1};mean={mean:.4f};var={max(squares / len(x) - mean * mean, 0):.3f};crossings={level}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def media_column(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each row's text stored as Ogg, read back, and described from what was read.

    A null text is empty, and so 64 zero samples.  A null doc_id stays null; repeated rows give repeated results, and an
    empty table none; other columns of docs, whatever their names, are not carried.  Texts are handled a few megabytes at
    a time, each whole; a long one is a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            out: dict[str, list] = {name: [] for name in names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                media = store(pad(text or b""), len(text or b""))
                payload, n_bytes, streams, rate = load(media)
                row = (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, streams, rate), media)
                for name, value in zip(names, row, strict=False):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(name, kinds[name]) for name in names]))

    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary()}
    names = [x for x in kinds if with_media or x != "media"]
    schema = SCHEMA if with_media else SCHEMA.replace(", media binary", "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
