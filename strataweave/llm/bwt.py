"""Suffix-array dedup by merging shard Burrows-Wheeler transforms.

Every byte goes that a 100-byte string covers which also starts earlier.  The steps:

1. Each 100-byte window has an anchor, the position of its smallest 48-byte hash, so equal windows have equal anchors.
   Windows next to each other with one anchor form a run.  Anchors' hashes are counted over all documents, packed by
   hash range; runs whose anchor occurs once hold no repeated window.
2. The other runs' strings, each its windows with nothing around them, go to the task of their anchor.  Equal strings
   are told apart by one of them, the first; the others are repeats as a whole.
3. What remains, distinct strings whose anchor has others, is cut into shards by document, at least four where there are
   as many documents.  A shard is sorted alone and gives a Burrows-Wheeler transform, whose symbols are the eight bytes before a rotation, ranked.  The shards' transforms are
   merged by refining an interleave: it starts with the shards one after the other, and each round stably sorts it by
   the symbols that its shards supply in turn, after which it is the order by eight more bytes.  Where symbols or
   former groups differ, a group ends; so after 12 rounds and one of four bytes the groups are the intervals with a
   common prefix of 100 bytes.  No suffixes of two shards are ever compared.  In each interval, all windows but the
   first are repeats.  Of documents with equal texts, only the first takes part: the others go as a whole.
4. An anchor with very many runs, as of a passage in a third of all documents, isn't gathered in one task: its strings
   go to the tasks of their own hashes, where equal ones are told apart, and the distinct ones then join the others in
   step 3.  Only where an anchor has very many distinct strings, their windows go one by one to the tasks of their own
   hashes instead.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_HASH, LAST_ID, cut, edges_of, flat_bytes, hot_join, input_bytes, mix, numbered, powers, text_chunks

WINDOW = 100
ANCHOR = 48
#: Occurrences of an anchor beyond which its strings are told apart in tasks of their own hashes first.
HOT = 2000
#: Distinct strings of such an anchor beyond which their windows are spread, so that no merge holds more than about 1.5 MB of one anchor.
MANY = 10_000
#: Symbols of a shard, and the least number of shards in a merge of so many strings.
SHARD_BYTES = 1 << 16
SHARDS = 4
#: Symbols that one merge holds.
MERGE_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
CHUNK = 1_500_000
#: The same where windows stand one by one.
STRING_CHUNK = 500_000
#: Windows of a text that are worked on at a time; their places fit into _PLACE.
STRETCH = 1 << 22
_PLACE = (1 << 28) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return powers(n), np.cumprod(inverse, dtype=np.uint64)


def runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run, in order; windows never cross rows.

    Long texts are worked on in stretches of so many windows.  A run ends where a stretch does; its anchor then counts
    twice, which only lets its windows be compared in vain.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n > stretch + window:
        parts = []
        for a in range(0, n - window + 1, stretch):
            b = min(a + stretch + window - 1, n)
            first, many, h = runs(data[a:b], np.clip(offsets - a, 0, b - a), window, anchor, stretch)
            parts.append((first + a, many, h))
        first, many, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        return first, many, h
    if n < window:
        return empty, empty, empty.astype(np.uint64)
    up, down = _powers(1 << max(21, (n + 1).bit_length()))
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * up[:n], out=h[1:])
    m = n - anchor + 1
    h = mix((h[anchor:] - h[:-anchor]) * down[:m])
    w = window - anchor + 1
    key = (h & ~np.uint64(_PLACE)) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // w) * w, ~np.uint64(0))
    padded[:m] = key
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    turn = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= window)
    np.add.at(turn, offsets[long], 1)
    np.add.at(turn, offsets[long + 1] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(turn)[: len(least)] > 0)
    if not len(at):
        return empty, empty, empty.astype(np.uint64)
    place = (least[at] & np.uint64(_PLACE)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    return at[first], np.diff(np.append(first, len(at))), h[place[first]]


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _chunk(number: int) -> int:
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) + number


def _asking(buckets: int):
    """Of each chunk: a row of what its runs are, and a row for each bucket of anchors to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(text_chunks(batches, limit=CHUNK)):
            data, offsets = flat_bytes(batch.column("text"))
            start, _, h = runs(data, offsets)
            keys, place, count = np.unique(h, return_inverse=True, return_counts=True)
            bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            present, edges = edges_of(bucket[order])
            low, count = (keys[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(count[order], 255).astype(np.uint8)
            rows = np.diff(np.searchsorted(start, offsets))
            head = np.concatenate([[len(offsets) - 1, len(start)], np.asarray(batch.column("doc_id")), np.asarray(batch.column("h")), np.asarray(batch.column("g")), rows]).astype(np.int64)
            chunk = _chunk(number)
            out = ([chunk % buckets], [head.tobytes() + rank[place].tobytes()], [np.append(present, edges).tobytes()])
            for b, x, y in zip(present.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for column, value in zip(out, (b, low[x:y].tobytes(), count[x:y].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([chunk] * len(out[0]), pa.int64()), pa.array([True] + [False] * (len(out[0]) - 1)), _binary(out[1]), _binary(out[2])], names=["bucket", "chunk", "known", "a", "b"])

    return run


def _counted(hot: int):
    def run(group: pa.Table) -> pa.Table:
        """For each chunk that asked: 0 for an anchor met once, 1 for more, 2 for very many."""
        known, a, b = group["known"].to_pylist(), group["a"].to_pylist(), group["b"].to_pylist()
        asks = [i for i, k in enumerate(known) if not k]
        low = [np.frombuffer(a[i], np.uint32) for i in asks]
        count = np.concatenate([*[np.frombuffer(b[i], np.uint8) for i in asks], np.zeros(0, np.uint8)])
        _, place = np.unique(np.concatenate([*low, np.zeros(0, np.uint32)]), return_inverse=True)
        total = np.bincount(place, weights=count)[place] if len(count) else count
        state, at = (total > 1).astype(np.uint8) + (total > hot), 0
        for i, key in zip(asks, low, strict=True):
            a[i], b[i] = state[at : at + len(key)].astype(np.uint8).tobytes(), b""
            at += len(key)
        return pa.table([group["chunk"], group["bucket"], group["known"], _binary(a), _binary(b)], names=["chunk", "bucket", "known", "a", "b"])

    return run


def _flagged(group: pa.Table) -> pa.Table:
    """(doc_id, h, g, flags, hot) of each document with a run whose anchor is met again: a byte for each of its runs."""
    known, bucket, a, b = (group[c].to_pylist() for c in ("known", "bucket", "a", "b"))
    me = known.index(True)
    n, k = np.frombuffer(a[me], np.int64, 2)
    ids, hashes, others, rows = np.frombuffer(a[me], np.int64, 4 * n, 16).reshape(4, n)
    place = np.frombuffer(a[me], np.uint32, k, 16 + 32 * n)
    present, edges = np.array_split(np.frombuffer(b[me], np.int64), [len(b[me]) // 16])
    state = np.zeros(int(edges[-1]), np.uint8)
    at = np.searchsorted(present, bucket)
    for i, is_known in enumerate(known):
        if not is_known:
            state[edges[at[i]] : edges[at[i] + 1]] = np.frombuffer(a[i], np.uint8)
    mine = state[place]
    ends = np.cumsum(rows)
    out = [(i, x, y, mine[e - r : e].tobytes()) for i, x, y, e, r in zip(ids.tolist(), hashes.tolist(), others.tolist(), ends.tolist(), rows.tolist(), strict=True) if r and mine[e - r : e].any()]
    return pa.table([*[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], _binary([x[3] for x in out]), pa.array([2 in x[3] for x in out], pa.bool_())], names=["doc_id", "h", "g", "flags", "hot"])


# --- shards -------------------------------------------------------------------------------------------------------


def _ranked(values: np.ndarray) -> np.ndarray:
    """Each value's rank, in the smallest type for it."""
    _, rank = np.unique(values, return_inverse=True)
    return rank.astype(np.uint16 if not len(rank) or rank.max() < 1 << 16 else np.uint32)


def _stable(symbols: np.ndarray) -> np.ndarray:
    """The stable order of ranks, by radix sorts of 16 bits each."""
    if symbols.dtype == np.uint16:
        return np.argsort(symbols, kind="stable")
    order = np.argsort((symbols & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    return order[np.argsort((symbols >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]


def _ring(begin: np.ndarray, size: np.ndarray):
    """For strings end to end: the positions d bytes on, each string being a ring."""
    base, length = np.repeat(begin, size), np.repeat(size, size)
    inside = np.arange(len(base)) - base
    return lambda d: base + (inside + d) % length


def shard_order(rank: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int = 128) -> np.ndarray:
    """The rotations of a shard's strings, as positions, sorted by depth bytes; rank is their order by the first eight."""
    ahead, n, d = _ring(begin, size), len(rank), 8
    rank = rank.astype(np.int64)
    while d < depth:
        values, rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead(d)], return_inverse=True)
        if len(values) == n:
            break
        d *= 2
    return np.argsort(rank, kind="stable")


def merge(rounds: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards (a shard's number for each place), and each place's group of equal prefixes.

    Each round has the shards' transforms by the symbols of its width; widths add up to the prefix's length.
    """
    shard = np.repeat(np.arange(len(rounds[0]), dtype=np.uint16), [len(t) for t in rounds[0]])
    group = np.zeros(len(shard), np.int32)
    for transforms in rounds:
        symbols = np.concatenate(transforms)
        sym = np.empty_like(symbols)
        sym[np.argsort(shard, kind="stable")] = symbols  # each shard supplies its symbols in its own order
        order = _stable(sym)
        shard, sym, group = shard[order], sym[order], group[order]
        group = np.cumsum(np.append(False, (sym[1:] != sym[:-1]) | (group[1:] != group[:-1])), dtype=np.int32)
    return shard, group


def shard_cuts(size: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Where shards of about shard_bytes begin among strings, and the end: SHARDS of them at least, if there are as many strings."""
    total = int(size.sum())
    least = [len(size) * i // SHARDS for i in range(SHARDS)]
    cuts = least if total <= SHARDS * shard_bytes else np.searchsorted(np.cumsum(size), np.arange(0, total, shard_bytes))
    return np.append(np.unique(cuts), len(size))


def repeats(data: np.ndarray, size: np.ndarray, windows: np.ndarray, doc: np.ndarray, start: np.ndarray, shard_bytes: int = SHARD_BYTES, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of all windows of several strings that also start earlier, by document and start."""
    ends = np.cumsum(size)
    begin = ends - size
    ahead = _ring(begin, size)
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | data[ahead(i)].astype(np.uint64)
    rank8, rank4 = _ranked(key), _ranked(key >> np.uint64(32))
    before8, before4 = rank8[ahead(-8)], rank4[ahead(-4)]
    cuts = shard_cuts(size, shard_bytes)
    places = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        places.append(shard_order(rank8[begin[a] : ends[b - 1]], begin[a:b] - begin[a], size[a:b]) + begin[a])
    wide, narrow = [before8[p] for p in places], [before4[p] for p in places]
    # the first round is the last bytes of the prefix
    shard, group = merge([*[narrow] * (depth % 8 // 4), *[wide] * (depth // 8)])
    position = np.empty(len(shard), np.int64)
    position[np.argsort(shard, kind="stable")] = np.concatenate(places)
    string = np.repeat(np.arange(len(size)), size)[position]
    offset = position - begin[string]
    real = offset < windows[string]
    string, offset, group = string[real], offset[real], group[real]
    order = np.lexsort((start[string] + offset, doc[string], group))
    string, offset, group = string[order], offset[order], group[order]
    fresh = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    again = (doc[string] != doc[string[first]]) | (start[string] + offset != start[string[first]] + offset[first])
    return string[again], offset[again]


def _dictionary(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each of several strings in data, equal for equal strings."""
    flat = _gather(data, begin, size)
    return np.asarray(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode().indices, dtype=np.int64)


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def window_hashes(data: np.ndarray, begin: np.ndarray, window: int | np.ndarray = WINDOW) -> np.ndarray:
    """A hash of the window, or of as many bytes as window says, at each place."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    window = np.broadcast_to(window, len(begin))
    widest = int(window.max())
    if len(data) > STRETCH + widest:  # begin is ascending
        parts = []
        for a in range(0, len(data), STRETCH):
            mine = slice(*np.searchsorted(begin, [a, a + STRETCH]))
            parts.append(window_hashes(data[a : a + STRETCH + widest - 1], begin[mine] - a, window[mine]))
        return np.concatenate(parts)
    up, down = _powers(1 << max(21, (len(data) + 1).bit_length()))
    h = np.append(np.uint64(0), np.cumsum(BYTE_HASH[data] * up[: len(data)], dtype=np.uint64))
    return mix((h[begin + window] - h[begin]) * down[begin])


def _first(code: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each string, the place of the earliest that equals it."""
    order = np.lexsort((start, doc, code))
    fresh = np.append(True, code[order][1:] != code[order][:-1])
    out = np.empty(len(code), np.int64)
    out[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return out


#: Windows of a copy: all that its text has.
WHOLE = -1
#: Of a bucket: its strings' key, document, text hash, start and windows; the same but the key of windows known to be repeats; bytes.
PACKED = "bucket int, meta binary, gone binary, data binary"
NAMES = ["bucket", "meta", "gone", "data"]
#: Of a bucket of documents: document, text hash, start and windows of what is known to be repeats.
GONE = "part int, gone binary"
REMOVED = "doc_id long, h long, at array<long>"
DISTINCT = "key long, doc_id long, h long, start long, n long, data binary, " + GONE


def _packed(route: np.ndarray, keys: np.ndarray, places: np.ndarray, code: np.ndarray, data: np.ndarray, begin: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Strings of data, one row for each bucket of the hashes in route; places has document, text hash, start and windows of each.

    Equal strings, those of one code, leave as the first of them.  A bucket's row has all that is known of its strings,
    so that it is whole whichever attempt of a task it comes from.
    """
    if not len(begin):
        return
    doc, text, at, windows = places
    size = windows + WINDOW - 1
    first = _first(code, doc, at)
    mine = first == np.arange(len(first))
    later = ~mine & ((doc != doc[first]) | (at != at[first]))
    bucket = ((route >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    present, edges = edges_of(bucket[order])
    out: tuple[list, ...] = ([], [], [], [])
    for b, x, y in zip(present.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        all_of = order[x:y]
        k, gone = all_of[mine[all_of]], all_of[later[all_of]]
        meta = np.stack([keys[k].view(np.int64), doc[k], text[k], at[k], windows[k]])
        row = b, meta.tobytes(), np.stack([doc[gone], text[gone], at[gone], windows[gone]]).tobytes(), _gather(data, begin[k], size[k]).tobytes()
        for column, value in zip(out, row, strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[_binary(x) for x in out[1:]]], names=NAMES)


def _strings(buckets: int, flag: int):
    """The strings of runs with this flag: those of 1 go to their anchor's bucket, those of 2 to their own hash's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=STRING_CHUNK):
            data, offsets = flat_bytes(batch.column("text"))
            start, n, h = runs(data, offsets)
            mine = np.flatnonzero(np.frombuffer(b"".join(batch.column("flags").to_pylist()), np.uint8) == flag)
            begin, windows, h = start[mine], n[mine], h[mine]
            row = np.searchsorted(offsets, begin, side="right") - 1
            places = np.stack([np.asarray(batch.column("doc_id"))[row], np.asarray(batch.column("h"))[row], begin - offsets[row], windows])
            size = windows + WINDOW - 1
            code = _dictionary(data, begin, size)
            yield from _packed(h if flag == 1 else window_hashes(data, begin, size), h, places, code, data, begin, buckets)

    return run


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's strings (key, document, text hash, start, windows; bytes), the place of the first equal one, and what is gone."""
    metas, gone = group["meta"].to_pylist(), group["gone"].to_pylist()
    meta = np.concatenate([np.frombuffer(m, np.int64).reshape(5, -1) for m in metas], axis=1)
    data = np.frombuffer(b"".join(group["data"].to_pylist()), np.uint8)
    size = meta[4] + WINDOW - 1
    first = _first(_dictionary(data, np.cumsum(size) - size, size), meta[1], meta[3])
    later = (first != np.arange(len(first))) & ((meta[1] != meta[1, first]) | (meta[3] != meta[3, first]))
    return meta, data, first, np.concatenate([*[np.frombuffer(g, np.int64).reshape(4, -1) for g in gone], meta[1:, later]], axis=1)


def _by_document(gone: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """What is gone, packed for the buckets of its documents."""
    part = ((mix(gone[0].view(np.uint64)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    present, edges = edges_of(part[order])
    return present.tolist(), [gone[:, order[x:y]].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _stretches(group: pa.Table) -> pa.Table:
    """For each document of a bucket, start and windows of what is gone, end to end, neighbours joined."""
    doc, text, start, n = np.concatenate([np.frombuffer(g, np.int64).reshape(4, -1) for g in group["gone"].to_pylist()], axis=1)
    order = np.lexsort((start, text, doc))
    doc, text, start, n = doc[order], text[order], start[order], n[order]
    other = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
    fresh = np.flatnonzero(other | np.append(True, start[1:] != start[:-1] + n[:-1]))
    at = np.stack([start[fresh], np.add.reduceat(n, fresh)], axis=1).reshape(-1)
    lead = np.flatnonzero(other)
    offsets = np.append(2 * np.searchsorted(fresh, lead), len(at)).astype(np.int32)
    return pa.table([pa.array(doc[lead]), pa.array(text[lead]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at))], names=["doc_id", "h", "at"])


def _distinct(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """A bucket's distinct strings, with their anchor as key, and what is gone."""
        meta, data, first, gone = _unpacked(group)
        size = meta[4] + WINDOW - 1
        begin = np.cumsum(size) - size
        keep = np.flatnonzero(first == np.arange(len(first)))
        texts = [data[b : b + n].tobytes() for b, n in zip(begin[keep].tolist(), size[keep].tolist(), strict=True)]
        parts, packed = _by_document(gone, buckets)
        none = [None] * len(parts)
        numbers = [pa.array(x[keep].tolist() + none, pa.int64()) for x in meta]
        return pa.table([*numbers, _binary(texts + none), pa.array([None] * len(keep) + parts, pa.int32()), _binary([None] * len(keep) + packed)], names=["key", "doc_id", "h", "start", "n", "data", "part", "gone"])

    return run


def _again(buckets: int, windows_apart: bool):
    """Distinct strings, packed for their anchors' buckets, or their windows one by one for those of their own hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "data", limit=STRING_CHUNK):
            data, offsets = flat_bytes(batch.column("data"))
            key, doc, text, at, n = (np.asarray(batch.column(c)) for c in ("key", "doc_id", "h", "start", "n"))
            begin, h = offsets[:-1], key.view(np.uint64)
            if windows_apart:
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                begin, doc, text, at = np.repeat(begin, n) + inside, np.repeat(doc, n), np.repeat(text, n), np.repeat(at, n) + inside
                n, h = np.ones(len(begin), np.int64), window_hashes(data, begin)
            yield from _packed(h, h, np.stack([doc, text, at, n]), _dictionary(data, begin, n + WINDOW - 1), data, begin, buckets)

    return run


def _merged(group: pa.Table) -> np.ndarray:
    """Document, text hash, start and windows of what also starts earlier."""
    (key, doc, text, start, windows), data, first, gone = _unpacked(group)
    out = [gone]
    size = windows + WINDOW - 1
    begin = np.cumsum(size) - size
    # a string alone under its anchor shares no window
    keep = np.flatnonzero(first == np.arange(len(first)))
    keep = keep[np.argsort(key[keep], kind="stable")]
    same = key[keep][1:] == key[keep][:-1]
    keep = keep[np.append(False, same) | np.append(same, False)] if len(keep) else keep
    done = 0
    while done < len(keep):
        ends = np.cumsum(size[keep[done:]])
        stop = done + max(int(np.searchsorted(ends, MERGE_BYTES, side="right")), 1)
        while stop < len(keep) and key[keep[stop]] == key[keep[stop - 1]]:
            stop += 1
        k = keep[done:stop]
        k = k[np.argsort(doc[k], kind="stable")]  # so that shards are of documents, and an anchor's strings in several
        string, offset = repeats(_gather(data, begin[k], size[k]), size[k], windows[k], doc[k], start[k])
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        fresh = np.flatnonzero(np.append(True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(string) else string
        n = np.diff(np.append(fresh, len(string)))
        s = k[string[fresh]]
        out.append(np.stack([doc[s], text[s], start[s] + offset[fresh], n]))
        done = stop
    return np.concatenate(out, axis=1)


def _packed_repeats(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        parts, packed = _by_document(_merged(group), buckets)
        return pa.table([pa.array(parts, pa.int32()), _binary(packed)], names=["part", "gone"])

    return run


def spans(starts: np.ndarray, n: np.ndarray, total: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches of total bytes that windows cover, n from each start."""
    n = np.where(n == WHOLE, total - window + 1, n)
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], (starts + n - 1 + window)[order]
    reach = np.maximum.accumulate(b)
    fresh = np.append(True, a[1:] > reach[:-1])
    return a[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(a) - 1)]


def repeated_windows(docs: DataFrame, hot: int = HOT, many: int = MANY, buckets: int | None = None) -> DataFrame:
    """(doc_id, h, at): windows that also start earlier, start and number end to end; a number is WHOLE for all of a text.

    A document without any has no row.  docs has doc_id, text and two hashes of the text, h and g, none null.
    """
    buckets = buckets or max(64, math.ceil(input_bytes(docs) / BUCKET_BYTES))
    asked = docs.mapInArrow(_asking(buckets), "bucket int, chunk long, known boolean, a binary, b binary")
    counted = asked.groupBy("bucket").applyInArrow(_counted(hot), "chunk long, bucket int, known boolean, a binary, b binary")
    found = counted.groupBy("chunk").applyInArrow(_flagged, "doc_id long, h long, g long, flags binary, hot boolean")
    flagged = cut(found.groupBy("doc_id", "h").agg(*[F.first(c).alias(c) for c in ("g", "flags", "hot")]))
    firsts = flagged.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    # a text alone, or the first of equal ones
    lead = flagged.join(firsts.select(F.col("first").alias("doc_id"), "h", "g"), ["doc_id", "h", "g"], "left_semi").select("doc_id", "h", "flags", "hot")
    copies = hot_join(flagged.select("doc_id", "h", "g"), firsts.where("c > 1"), ["h", "g"], "c").where("doc_id <> first").select("doc_id", "h", F.array(F.lit(0).cast("long"), F.lit(WHOLE).cast("long")).alias("at"))

    def strings(some: DataFrame, flag: int) -> DataFrame:
        return docs.select("doc_id", "text", "h").join(some, ["doc_id", "h"]).select("doc_id", "h", "text", "flags").mapInArrow(_strings(buckets, flag), PACKED)

    def listed(packed: DataFrame) -> DataFrame:
        return packed.groupBy("part").applyInArrow(_stretches, REMOVED).union(copies)

    plain = strings(lead, 1)
    if flagged.where("hot").isEmpty():
        return listed(plain.groupBy("bucket").applyInArrow(_packed_repeats(buckets), GONE))
    told = cut(strings(lead.where("hot"), 2).groupBy("bucket").applyInArrow(_distinct(buckets), DISTINCT))
    alone = told.where("data is not null")
    crowded = cut(alone.groupBy("key").count().where(F.col("count") > many).select("key"))
    small = crowded.count() <= 1 << 20  # 8 MB of keys, as many as their strings by MANY
    crowded = F.broadcast(crowded) if small else crowded
    few = alone.join(crowded, "key", "left_anti").mapInArrow(_again(buckets, False), PACKED)
    lots = alone.join(crowded, "key", "left_semi").mapInArrow(_again(buckets, True), PACKED)
    removed = plain.union(few).union(lots).groupBy("bucket").applyInArrow(_packed_repeats(buckets), GONE)
    return listed(removed.union(told.where("data is null").select("part", "gone")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _with_windows(docs: DataFrame, **options: int) -> DataFrame:
    """docs (doc_id, text, h, others) and at, the repeated windows of each: start and n end to end."""
    removed = repeated_windows(docs.select("doc_id", "text", "h", F.xxhash64(F.lit(1), "text").alias("g")), **options)
    return docs.join(removed, ["doc_id", "h"], "left")


def _pairs(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    column = batch.column("at")
    sizes = np.diff(flat_bytes(batch.column(text))[1])
    for i in range(batch.num_rows):
        if column[i].is_valid and len(column[i]):
            yield spans(*np.asarray(column[i].values, dtype=np.int64).reshape(-1, 2).T, int(sizes[i]))
        else:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)


def removed_bytes(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    A null text is empty.  A null doc_id comes after all others.  Rows repeated with the same doc_id and text are one
    document, and are each answered; with one doc_id and different texts they are one document's starts.
    Long texts are worked on whole, in stretches; an empty table gives no rows.  Of windows that tie, the one of the
    smallest doc_id and start stays.  Other columns play no part whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=2 * CHUNK):
            out: list[tuple] = []
            for text, (a, b) in zip(batch.column("text").cast(pa.binary()).to_pylist(), _pairs(batch), strict=True):
                view, digest, at = memoryview(text), hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    digest.update(view[at:x])
                    at = y
                digest.update(view[at:])
                out.append((len(text), int((b - a).sum()), len(a), digest.hexdigest()))
            ids = np.asarray(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == LAST_ID), *[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], pa.array([x[3] for x in out], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = _keyed(docs).withColumn("h", F.xxhash64("text"))
    return _with_windows(keyed, **options).select("doc_id", "text", "at").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(docs: DataFrame, **options: int) -> DataFrame:
    """docs with their repeated passages cut out of text; characters that a cut would split stay whole.

    Other columns stay as they are whatever their names, but n_chars follows the text if there is one.  Null and empty
    texts stay; texts of which nothing is left are empty.  Rows repeated under one doc_id are one document, as in
    removed_bytes.  Long texts are cut whole; an empty table stays empty.
    """
    plain, names = numbered(docs)
    text_name, chars_name, kept = names["text"], names.get("n_chars"), list(names.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_name, limit=2 * CHUNK):
            texts = []
            for text, (a, b) in zip(batch.column(text_name).cast(pa.binary()).to_pylist(), _pairs(batch, text_name), strict=True):
                if text is None or not len(a):
                    texts.append(None if text is None else text.decode())
                    continue
                pieces, at = [], 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    while x < len(text) and text[x] & 0xC0 == 0x80:  # inside a character: keep all of it
                        x += 1
                    while y > x and y < len(text) and text[y] & 0xC0 == 0x80:
                        y -= 1
                    if y > x:
                        pieces.append(text[at:x])
                        at = y
                texts.append(b"".join([*pieces, text[at:]]).decode())
            made = {text_name: pa.array(texts, pa.string())}
            if chars_name:
                made[chars_name] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column(chars_name).type)
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in kept], names=kept)

    text = F.coalesce(text_name, F.lit(""))
    keyed = plain.withColumns({"id": F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(LAST_ID)), "h": F.xxhash64(text)})
    removed = repeated_windows(keyed.select(F.col("id").alias("doc_id"), text.alias("text"), "h").withColumn("g", F.xxhash64(F.lit(1), "text")), **options)
    return keyed.join(removed.withColumnRenamed("doc_id", "id"), ["id", "h"], "left").select(*kept, "at").mapInArrow(run, plain.schema).toDF(*names)
