"""Times of pages and packets, chains, and stored columns against a slow reader."""

import hashlib
import random
import struct
import zlib

import pytest

from strataweave.llm import ogg


def slow_streams(media):
    """Each stream's packets with the time in samples at which they end, and its pages' granules: byte by byte."""
    out, at = {}, 0
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        kind, granule, serial, sequence, checksum, n = struct.unpack_from("<BqIIIB", media, at + 5)
        lacing = media[at + 27 : at + 27 + n]
        page = media[at : at + 27 + n + sum(lacing)]
        r = 0
        for i, b in enumerate(page):
            r ^= (0 if 22 <= i < 26 else b) << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        assert r == checksum
        s = out.setdefault(serial, {"packets": [], "open": b"", "pages": [], "next": 0})
        assert s["next"] == sequence and bool(kind & 1) == bool(s["open"]) and bool(kind & 2) == (sequence == 0)
        s["next"] += 1
        body, fresh = page[27 + n :], []
        for v in lacing:
            s["open"] += body[:v]
            body = body[v:]
            if v < 255:
                fresh.append(s["open"])
                s["open"] = b""
        ends = []
        for data in reversed(fresh):
            ends.insert(0, granule)
            granule -= 0 if data[:4] == b"PCM8" and len(data) == 12 else len(data)
        s["packets"] += zip(fresh, ends, strict=True)
        s["pages"].append(struct.unpack_from("<q", page, 6)[0])
        at += len(page)
    return out


def test_column_against_slow_reader(llm):
    r = random.Random(1)
    texts = [None, "", "x", "é" * 31, "a" * 64, " ".join(str(r.random()) for _ in range(900)), "z" * 4080, "\0" * 9000]
    df = llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in ogg.media_column(df).collect():
        raw = (texts[row["doc_id"]] or "").encode()
        padded = raw + b"\0" * ((-len(raw) % 64) or (0 if raw else 64))
        s = slow_streams(bytes(row["media"]))[1]
        payload = b"".join(p for p, _ in s["packets"][1:])
        assert payload == padded and row["payload_sha256"] == hashlib.sha256(padded).hexdigest() and row["tail_crc32"] == zlib.crc32(padded[-64:])
        assert (row["n_bytes"], row["payload_bytes"], row["media_bytes"]) == (len(raw), len(padded), len(row["media"]))
        pages = [g * 125 for g in s["pages"]]  # microseconds of a sample
        packets = [g * 125 for _, g in s["packets"]]
        assert f"us={packets[-1]};times={zlib.crc32(struct.pack(f'<{len(pages) + len(packets)}q', *pages, *packets)):08x};" in row["feature"]
        found = ogg.times(ogg.load(bytes(row["media"]))[2][1], 8000, ogg.samples_in)
        assert found == (pages, packets)


def test_packets_that_span_pages():
    sizes = [0, 10, 70_000, 5, 200_000, 300]
    packets, now = [], 0
    for n in sizes:
        now += n
        packets.append((bytes([n % 251]) * n, now))
    stream = ogg.demux(ogg.mux({4: packets}))[4]
    pages, ends = ogg.times(stream, 1_000_000, len)
    assert ends == [g for _, g in packets]
    assert None in pages and [p for p in pages if p is not None] == sorted(p for p in pages if p is not None) and pages[-1] == now


def test_chain():
    a, b = ogg.store(ogg.pad(b"one" * 3000), 9000), ogg.store(ogg.pad(b"two"), 3)
    links = ogg.demux_chain(a + b + a)
    assert [b"".join(p.data for p in x[1].packets[1:])[:3] for x in links] == [b"one", b"two", b"one"]
    start, seen = 0, []
    for link in links:
        _, packets = ogg.times(link[1], 8000, ogg.samples_in, start)
        seen += packets
        start = packets[-1]
    assert seen == sorted(seen) and start == (9024 * 2 + 64) * 125
    with pytest.raises(ogg.OggError):
        ogg.demux(a + b)
    first = ogg.HEADER.size + 1 + 12
    for wrong in (a + a[:first], a + b[first:], a[:first] + a):
        with pytest.raises(ogg.OggError):
            ogg.demux_chain(wrong)
    assert ogg.demux_chain(b"") == []
