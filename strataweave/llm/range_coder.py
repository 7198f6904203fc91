"""Token ids in blocks of an adaptive context-mixing range coder.

Ids (0 to 65535) are cut into blocks of BLOCK ids.  A block starts from an empty model, so it decodes alone, and has a
checksum of its coded bytes and one of its ids.  Its ids lie in lanes, one after the other; all lanes take a step
together and share one model, which learns from every lane's id after each step:

* order 2: a table of slots, each checked by 23 bits of its context's hash, with two candidates and their counts;
* order 1: for each id, the distribution of the ids that have followed it, renewed as the number of steps doubles;
* order 0: the distribution of the ids that the others did not hold, and a uniform one for what is new to it.

Candidates' counts together with how much order 1 has seen after this id are a state; each state has learnt how often
which of the four predictions was right, and these weights mix them into one interval of 2 ** 28 for the next id, which
a range coder with a 48-bit window takes.  All arithmetic is in integers (and in doubles where these are exact).

A segment holds whole documents:

    bytes  meaning
    8      magic and version
    4      number of documents, 4: number of blocks, 8: number of ids
    ...    document ids (8 each; NULL_ID for null), then their numbers of ids (4 each)
    ...    for each block: number of coded bytes (4), crc32 of them (4), crc32 of the ids (4)
    ...    the blocks' bytes, and the crc32 of all before (4)

A block's bytes are the lanes' numbers of 16-bit words (2 bytes each), then the lanes' words.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, flat_bytes, scratch, text_chunks

MAGIC = b"SWTIDS\0\3"
NULL_ID = -(1 << 63)
#: Ids of a block.
BLOCK = 1 << 22
#: From so many ids on, a block has twice the lanes and so half the steps.
LARGE = 1 << 20
#: Ids of a segment, if its last document doesn't make it longer.
SEGMENT = 2 * BLOCK
SLOT_BITS = 18
IDS = 1 << 16
#: An interval is a prediction's share of 2 ** SHARE_BITS times an id's share of 2 ** 16.
SHARE_BITS = 12
TOTAL_BITS = SHARE_BITS + 16
#: Order 0 holds so many ids at most, the most frequent; the others are coded uniformly.
HELD = 1 << 15


class CorruptError(ValueError):
    """A segment or block whose checksum or form is wrong."""


# What is right: the first or second candidate of order 2, order 1, or order 0.
FIRST, SECOND, ORDER1, ORDER0 = range(4)
KINDS = 4
#: A state's counts before it has seen anything, and what one turn adds.
_START, _TURN = np.array([6, 2, 4, 4], np.int64), 8


def _level(n: np.ndarray, cuts: list[float]) -> np.ndarray:
    return np.searchsorted(cuts, n, side="right").astype(np.int64)


# The two candidates' counts, 4 bits each, as one of 18 levels; order 1 has 40, its first for nothing seen.
_COUNTS = np.arange(256)
_LEVELS1 = 40
_STATES = 18 * _LEVELS1
_STATE2 = KINDS * _LEVELS1 * (3 * _level(_COUNTS & 15, [1, 2, 4, 8, 15]) + _level(_COUNTS >> 4, [1, 3]))


def _turns() -> tuple[np.ndarray, np.ndarray]:
    """For what was right (first, second, neither) and a slot's counts: the new counts, and 16 if the candidates change places."""
    new, swap = np.zeros((3, 256), np.int64), np.zeros((3, 256), np.int64)
    for counts in range(256):
        a, b = counts & 15, counts >> 4
        after = [
            (min(a + 1, 15), b - (a > 8 and b > 3), False),
            (a - (a > 6), min(b + 1, 15), b + 1 >= a),
            (a - (a > 1), 1, a <= 2),  # the second gives way to the id that came
        ]
        for right, (x, y, changed) in enumerate(after):
            new[right, counts], swap[right, counts] = (y | x << 4, 16) if changed else (x | y << 4, 0)
    return new.ravel(), swap.ravel()


_NEW_COUNTS, _SWAP = _turns()
_NEW_COUNTS <<= 32


_INDEX, _SPARE = (1 << 19) - 1, (1 << 17) - 1


def _pair_hash(pair: np.ndarray) -> np.ndarray:
    return pair * 0x2545F4914F >> 20 & _INDEX


def _spare_hash(pair: np.ndarray) -> np.ndarray:
    return pair * 0x9E3779B1 >> 13 & _SPARE


class _Model:
    """What a block's lanes have learnt."""

    def __init__(self, lanes: int, decodes: bool):
        self.decodes = decodes
        self.slots = np.zeros(1 << SLOT_BITS, np.int64)  # 16 bits each candidate, 4 each count, 23 of the context's hash
        self.right = np.tile(_START, _STATES)
        self.rare = np.zeros(IDS, np.int64)
        self.state1 = np.zeros(IDS, np.int64)
        self.sorted_pairs = np.zeros(0, np.uint32)
        self.info = np.zeros(0, np.int64)  # of each pair: its ids, 16 bits each, where its interval begins, and its width less 1
        self.met: list[np.ndarray] = []
        self.turns: list[np.ndarray] = []
        self.others: list[np.ndarray] = []
        if decodes:
            self.row = np.zeros(IDS, np.int64)  # a context's first cell, and in 5 bits by how much places are larger than cells
        else:
            self.index, self.spare = np.zeros(_INDEX + 1, np.int32), np.zeros(_SPARE + 1, np.int32)
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)
        self.step, self.next_weigh, self.next_relate = 0, 1, 2
        self._weigh()

    def _weigh(self) -> None:
        """The states' weights and order 0, from all turns so far."""
        if self.turns:
            self.right += np.bincount(np.concatenate(self.turns), minlength=_STATES * KINDS) * _TURN
            self.rare += np.bincount(np.concatenate(self.others), minlength=IDS)
            self.turns, self.others = [], []
        right = self.right.reshape(-1, KINDS)
        share = right * ((1 << SHARE_BITS) - KINDS) // right.sum(axis=1)[:, None] + 1
        share[:, ORDER0] += (1 << SHARE_BITS) - share.sum(axis=1)
        reached = np.cumsum(share, axis=1)
        self.share, self.below = share.ravel(), (reached - share).ravel() << 16
        self.reached = np.ascontiguousarray(reached.T << 16)
        held = np.flatnonzero(self.rare)
        if len(held) > HELD:
            held = np.sort(np.argsort(-self.rare, kind="stable")[:HELD])
        self.begin0, self.width0 = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
        self.room = 0
        if len(held):
            counts = self.rare[held]
            self.room = IDS - max(16, min(IDS // 4, len(held) * IDS // (2 * int(counts.sum()) + 16)))
            width = counts * (self.room - len(held)) // counts.sum() + 1
            width[np.argmax(width)] += self.room - width.sum()
            self.width0[held], self.begin0[held] = width, np.cumsum(width) - width
        if self.decodes:
            self.id_at = np.full(IDS, -1)
            if len(held):
                self.id_at[: self.room] = np.repeat(held, width)
        self.next_weigh = self.step + max(1, min(128, self.step // 4))

    def _relate(self) -> None:
        """Order 1, from all pairs so far."""
        self.sorted_pairs = np.sort(np.concatenate([self.sorted_pairs, *self.met]))
        self.met = []
        new = np.flatnonzero(np.append(True, self.sorted_pairs[1:] != self.sorted_pairs[:-1]))
        pairs = self.sorted_pairs[new].astype(np.int64)
        counts = np.diff(np.append(new, len(self.sorted_pairs)))
        context = pairs >> 16
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        total, kinds = np.add.reduceat(counts, first), np.diff(np.append(first, len(counts)))
        # bit lengths are exact on every machine, as logarithms need not be;
        # a context has four to eight cells for each id that followed it, at most 2 ** 12, or 2 ** 16 if that's too few
        bits = np.frexp(kinds - 1.0)[1].astype(np.int64) + 2
        bits = np.where(bits > 12, np.where(kinds < 1 << 11, 12, 16), bits)
        row = np.repeat(np.arange(len(first)), kinds)
        cells = counts * ((1 << bits) - kinds)[row] // total[row] + 1
        cells[first] += (1 << bits) - np.add.reduceat(cells, first)
        begin = np.cumsum(cells) - cells
        unit = 16 - bits
        self.info = pairs << 32 | begin - begin[first][row] << unit[row] << 16 | (cells << unit[row]) - 1
        self.state1[context[first]] = KINDS * (1 + 3 * np.minimum(np.frexp(total)[1].astype(np.int64) - 1, 12) + _level(total / kinds, [1.5, 4]))
        if self.decodes:
            self.row[context[first]] = begin[first] << 5 | unit
            self.pair_at = np.zeros(max(IDS, int(cells.sum())), np.int32)
            self.pair_at[: int(cells.sum())] = np.repeat(np.arange(len(counts), dtype=np.int32), cells)
        else:
            self._index(pairs)
        self.next_relate = self.step + max(2, self.step)

    def _index(self, pairs: np.ndarray) -> None:
        """Where a pair is; the few that neither table has room for count as not seen."""
        every = np.arange(len(pairs), dtype=np.int32)
        self.index.fill(0)
        self.index[_pair_hash(pairs)] = every
        lost = every[self.index[_pair_hash(pairs)] != every]
        self.spare.fill(0)
        self.spare[_spare_hash(pairs[lost])] = lost

    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether order 1 has the pairs, and what it has of them."""
        info = self.info[self.index[_pair_hash(pair)]]
        known = info >> 32 & 0xFFFFFFFF == pair
        rest = np.flatnonzero(~known)
        again, asked = self.info[self.spare[_spare_hash(pair[rest])]], pair[rest]
        info[rest] = again
        known[rest] = again >> 32 & 0xFFFFFFFF == asked
        return known, info

    def predict(self) -> None:
        h = self.one * 0x2545F4914F
        h += self.two * 0x9E3779B97F
        h ^= h >> 23
        self.slot = h & ((1 << SLOT_BITS) - 1)
        h >>= SLOT_BITS
        h &= 0x7FFFFF
        self.check = h
        known = self.slots[self.slot]
        known *= known >> 40 == h
        self.known = known
        self.first, self.second = known & (IDS - 1), known >> 16 & (IDS - 1)
        self.counts = known >> 32 & 255
        self.state = _STATE2[self.counts]
        self.state += self.state1[self.one]

    def learn(self, ids: np.ndarray, pair: np.ndarray, kind: np.ndarray, cell: np.ndarray, others: np.ndarray) -> None:
        """pair: ids after those before; kind: what was right; cell: the state's place for it; others: what order 0 coded.

        Where lanes share a slot, the last one's turn stays.
        """
        self.turns.append(cell)
        self.others.append(others)
        self.met.append(pair.astype(np.uint32))
        case = np.minimum(kind, 2)
        fresh = -(case >> 1)  # all bits where neither candidate was right; masks, as branches on them are mostly guessed wrong
        case <<= 8
        case |= self.counts
        candidates = ids << 16
        candidates |= self.first
        candidates ^= self.known
        candidates &= fresh
        candidates ^= self.known
        candidates &= 0xFFFFFFFF
        swap = _SWAP[case]
        slot = candidates << swap
        slot &= 0xFFFFFFFF
        candidates >>= swap
        slot |= candidates
        slot |= _NEW_COUNTS[case]
        self.check <<= 40
        slot |= self.check
        self.slots[self.slot] = slot
        self.two, self.one = self.one, ids
        self.step += 1
        if self.step >= self.next_weigh:
            self._weigh()
        if self.step >= self.next_relate:
            self._relate()


# The coder: an interval [low, low + span) of a 48-bit window.  A span below 2 ** 32 gives up the window's top 16 bits,
# to which a carry may still be added; carries run through a lane's words when the block is done.

_LEAST, _LOW32, _MOST = 1 << 32, (1 << 32) - 1, (1 << TOTAL_BITS) - 1


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and their steps; large blocks have enough steps to learn from with twice the lanes."""
    lanes = 1 << ((n.bit_length() + (2 if n < LARGE else 4)) // 2)
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray) -> bytes:
    lanes, steps = _lanes(len(ids))
    grid = np.zeros(lanes * steps, np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    room = 3 * steps + 4
    words, used = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room

    def settle() -> None:
        due = np.flatnonzero(span < _LEAST)
        while len(due):
            l, s, at = low[due], span[due] << 16, used[due]
            words[at] = l >> 32
            used[due] = at + 1
            low[due] = (l & _LOW32) << 16
            span[due] = s
            due = due[s < _LEAST]

    for t in range(steps):
        x = grid[t].astype(np.int64)
        model.predict()
        pair = model.one << 16
        pair |= x
        if len(model.info):
            known, info = model.find(pair)
            kind = ORDER0 - known.astype(np.int64)
            begin, part = info >> 16 & (IDS - 1), info & (IDS - 1)
            part += 1
        else:
            kind, begin, part = np.full(lanes, ORDER0), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        first, second = x == model.first, x == model.second
        kind -= SECOND
        kind &= second.astype(np.int64) - 1
        kind += SECOND
        kind &= first.astype(np.int64) - 1
        first |= second
        hit = first.astype(np.int64)
        keep = hit - 1
        begin &= keep
        part &= keep
        hit <<= 16  # all IDS cells
        part |= hit
        others = np.flatnonzero(kind == ORDER0)
        rare = x[others]
        width = model.width0[rare]
        begin[others], part[others] = model.begin0[rare], width
        new = others[width == 0]
        begin[new], part[new] = model.room, IDS - model.room
        cell = model.state + kind
        share = model.share[cell]
        unit = span >> TOTAL_BITS
        begin *= share
        begin += model.below[cell]
        begin *= unit
        low += begin
        share *= part
        np.multiply(unit, share, out=span)
        settle()
        if len(new):
            unit = span[new] >> 16
            low[new] += unit * x[new]
            span[new] = unit
            settle()
        model.learn(x, pair, kind, cell, rare)
    words[used] = (low + _LOW32) >> 32  # lies in the interval, whatever follows; the reader takes zeros
    size = used + 1 - np.arange(lanes) * room
    words = words.reshape(lanes, room)[:, : int(size.max())]
    words = words[np.arange(words.shape[1]) < size[:, None]]  # end to end; no carry leaves a lane
    while len(full := np.flatnonzero(words > 0xFFFF)):
        words[full] &= 0xFFFF
        words[full - 1] += 1
    return size.astype("<u2").tobytes() + words.astype("<u2").tobytes()


def decode_block(data: bytes, n: int) -> np.ndarray:
    lanes, steps = _lanes(n)
    size = np.frombuffer(data, "<u2", lanes).astype(np.int64)
    width = int(size.max()) + 6
    words = np.zeros((lanes, width), np.uint16)
    words[np.arange(width) < size[:, None]] = np.frombuffer(data, "<u2", int(size.sum()), 2 * lanes)
    words = words.ravel()
    used = np.arange(lanes) * width
    code = words[used].astype(np.int64) << 32 | words[used + 1].astype(np.int64) << 16 | words[used + 2]
    used += 3
    span = np.full(lanes, 1 << 48, np.int64)
    out = np.zeros((steps, lanes), np.int64)
    model = _Model(lanes, True)
    end = len(words) - 1

    def settle() -> None:
        due = np.flatnonzero(span < _LEAST)
        while len(due):
            s, at = span[due] << 16, used[due]
            code[due] = code[due] << 16 | words[np.minimum(at, end)]
            used[due] = at + 1
            span[due] = s
            due = due[s < _LEAST]

    for t in range(steps):
        model.predict()
        unit = span >> TOTAL_BITS
        value = (code / unit).astype(np.int64)  # exact: both are below 2 ** 53, quotients far from rounding
        np.minimum(value, _MOST, out=value)
        row = model.state >> 2
        kind = (value >= model.reached[0][row]).astype(np.int64)
        kind += value >= model.reached[1][row]
        kind += value >= model.reached[2][row]
        cell = model.state + kind
        share, below = model.share[cell], model.below[cell]
        value -= below
        inside = (value / share).astype(np.int64)
        if len(model.info):
            at = model.row[model.one]
            info = model.info[model.pair_at[(at >> 5) + (inside >> (at & 31))]]
            x, begin, part = info >> 32 & (IDS - 1), info >> 16 & (IDS - 1), info & (IDS - 1)
            part += 1
        else:
            x, begin, part = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        hit = (kind < ORDER1).astype(np.int64)
        keep = hit - 1
        begin &= keep
        part &= keep
        part |= hit << 16  # all IDS cells
        candidate = model.first ^ model.second
        candidate &= -(kind & 1)
        candidate ^= model.first
        x ^= candidate
        x &= keep
        x ^= candidate
        others = np.flatnonzero(kind == ORDER0)
        rare = model.id_at[inside[others]]
        x[others], begin[others], part[others] = rare, model.begin0[rare], model.width0[rare]
        new = others[rare < 0]
        begin[new], part[new] = model.room, IDS - model.room
        begin *= share
        begin += below
        begin *= unit
        code -= begin
        share *= part
        np.multiply(unit, share, out=span)
        settle()
        if len(new):
            unit = span[new] >> 16
            x[new] = np.minimum((code[new] / unit).astype(np.int64), IDS - 1)
            code[new] -= unit * x[new]
            span[new] = unit
            settle()
        out[t] = x
        pair = model.one << 16
        pair |= x
        model.learn(x, pair, kind, cell, x[others])
    return np.ascontiguousarray(out.T).reshape(-1)[:n].astype(np.int32)


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    coded = [encode_block(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    table = np.zeros((len(coded), 3), "<u4")
    for i, b in enumerate(coded):
        table[i] = len(b), zlib.crc32(b), zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes())
    out = MAGIC + struct.pack("<IIQ", len(doc_ids), len(coded), len(ids)) + doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + table.tobytes() + b"".join(coded)
    return out + struct.pack("<I", zlib.crc32(out))


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids.  Raises CorruptError if anything doesn't agree."""
    if data[:8] != MAGIC or len(data) < 28 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise CorruptError("not a whole segment")
    n_docs, n_blocks, n = struct.unpack_from("<IIQ", data, 8)
    at = 24
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
    table = np.frombuffer(data, "<u4", 3 * n_blocks, at + 12 * n_docs).reshape(n_blocks, 3).astype(np.int64)
    at += 12 * n_docs + 12 * n_blocks
    parts = [np.zeros(0, np.int32)]
    for i, (size, coded_crc, ids_crc) in enumerate(table.tolist()):
        coded = data[at : at + size]
        at += size
        if zlib.crc32(coded) != coded_crc:
            raise CorruptError(f"block {i} is damaged")
        parts.append(decode_block(coded, min(BLOCK, n - i * BLOCK)))
        if zlib.crc32(parts[-1].astype("<u4").tobytes()) != ids_crc:
            raise CorruptError(f"block {i} decodes to other ids")
    return doc_ids, lengths, np.concatenate(parts)


# --- tokens -------------------------------------------------------------------------------------------------------

# What a byte may be: ASCII that is not white space; the lead of a two-byte character that is not; a later byte; an
# ASCII letter; an ASCII mark (neither letter nor digit, and not the apostrophe, which may begin a contraction); a gap.
_PLAIN, _LEAD, _TAIL, _LETTER, _MARK, _GAP, _FEED = (1 << i for i in range(7))
_BYTE = np.zeros(256, np.uint8)
_BYTE[0x21:0x7F] = _PLAIN | _MARK
_BYTE[0xC3:0xE0] = _LEAD
_BYTE[0x80:0xC0] = _TAIL
_BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _PLAIN | _LETTER
_BYTE[[*range(0x30, 0x3A), 0x27]] = _PLAIN
_BYTE[[0x20, 0x0A]] = _GAP
_BYTE[0x0A] |= _FEED


#: Byte-level characters: a printable byte is itself, the others follow from 256; a line feed stands between words here.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = np.zeros(256, "<u4")
_LETTERS[_SHOWN] = _SHOWN
_LETTERS[[b for b in range(256) if b not in _SHOWN]] = np.arange(256, 256 + 256 - len(_SHOWN))
_LETTERS[0x0A] = 0x20


def _each(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column that holds no null, cut from its buffer."""
    raw = column.buffers()
    ends = np.frombuffer(raw[1], np.int64, len(column) + 1, 8 * column.offset).tolist()
    data = raw[2].to_pybytes() if raw[2] is not None else b""
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _piece_groups(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of pieces end to end: 0 for a blank and letters, 1 for others that begin with a blank and end with a character that
    isn't white space, 2 for the rest."""
    last = np.cumsum(size) - 1
    first = last - size + 1
    what = _BYTE[data]
    # beyond ASCII, a letter is C3 and a byte from 80 on, but for the signs of multiplication and division
    tail = (what & _TAIL != 0) & (data != 0x97) & (data != 0xB7)
    tail[1:] &= data[:-1] == 0xC3
    letter = (what & _LETTER != 0) | tail
    letter[:-1] |= (data[:-1] == 0xC3) & tail[1:]
    blank = data[first] == 0x20
    letter[first] = blank
    end, was = data[last], data[np.maximum(last - 1, 0)]
    ends = (end > 0x20) & (end < 0x7F) | (what[last] & _TAIL != 0) & (was >= 0xC3) & (was < 0xE0)
    word = np.logical_and.reduceat(letter, first) & (size > 1)
    return np.where(word, 0, np.where(blank & (size > 1) & ends, 1, 2))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, with the pieces it has met."""
    return Encoder(path)


class Encoder:
    """The library's ids of many texts: texts are cut where its splitting pattern always cuts, and each distinct piece is encoded once.

    A single space or line feed between two characters that aren't white space begins a piece of the pattern's own, and a
    line feed is one by itself.  A mark after an ASCII letter begins a piece too, as no piece of the pattern holds both.
    Next to characters that might be white space beyond ASCII, texts aren't cut.
    """

    KEPT = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # its texts are byte-level words with blanks between
        # in a byte-level vocabulary a token has as many characters as bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(k) for k in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def learn(self, fresh: list[bytes]) -> None:
        """Encode pieces: those of a blank and letters as the model's own words, others that begin with a blank in long
        texts, where one following another is a cut, and the rest one by one."""
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        group = _piece_groups(np.frombuffer(b"".join(fresh), np.uint8), size)
        fresh = [fresh[i] for i in np.argsort(group, kind="stable").tolist()]
        a, b = np.cumsum(np.bincount(group, minlength=3))[:2].tolist()
        words, plain, alone = fresh[:a], fresh[a:b], fresh[b:]
        texts = [_LETTERS[np.frombuffer(b"\n".join(words[i : i + 256]), np.uint8)].tobytes().decode("utf-32-le") for i in range(0, len(words), 256)]
        found = self.bare.encode_batch_fast(texts, add_special_tokens=False)
        texts = [b"".join(plain[i : i + 256]).decode() for i in range(0, len(plain), 256)] + [k.decode() for k in alone]
        found += self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in found])
        reached = np.cumsum(self.n_bytes[ids])
        ends = np.searchsorted(reached, np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))) + 1
        self.known.update(zip(fresh, range(len(self.ends), len(self.ends) + len(fresh)), strict=True))
        self.ends = np.append(self.ends, len(self.flat) + ends)
        self.flat = np.append(self.flat, ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, rows end to end, and each row's number of them."""
        n = len(data)
        rows = len(offsets) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        what = _BYTE[data]
        was, now = what[:-1], what[1:]
        after = what & _PLAIN != 0  # ends a character that isn't white space
        after[1:] |= (now & _TAIL != 0) & (was & _LEAD != 0)
        before = what & (_PLAIN | _LEAD) != 0  # begins one
        single = np.zeros(n, bool)
        single[1:-1] = (what[1:-1] & _GAP != 0) & after[:-2] & before[2:]
        begin = single.copy()
        begin[1:] |= (now & _MARK != 0) & (was & _LETTER != 0) | single[:-1] & (was & _FEED != 0)
        begin[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(begin)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        kinds = _each(pieces.dictionary)
        if len(self.known) > self.KEPT:
            self.forget()
        which = np.fromiter(map(self.known.get, kinds, repeat(-1)), np.int64, len(kinds))
        fresh = np.flatnonzero(which < 0)
        if len(fresh):
            new = [kinds[i] for i in fresh]
            self.learn(new)
            which[fresh] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        which = which[np.asarray(pieces.indices, dtype=np.int64)]
        begins = np.append(0, self.ends)[which]
        count = self.ends[which] - begins
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1])) + np.repeat(begins - ends + count, count)
        first = np.searchsorted(starts, offsets)
        upto = np.append(0, ends)
        return self.flat[at].astype(np.int32), upto[first[1:]] - upto[first[:-1]]


def write_ids(docs: DataFrame, path: str, tokenizer: str, partitions: int, end_id: int = 0) -> None:
    """Files of segments, in ascending doc_id order over the files (`part`) and inside them (`segment`); nulls first, ties by text.

    Each document's ids end with end_id; a null text has that alone.  Repeated rows are written as often as they come,
    other columns of docs whatever their names are left out, and an empty table gives files without segments.  A long
    text is encoded whole; its ids fill as many blocks as they need, of which one at a time is coded.  Spark's writer
    commits files whole, so a lost executor leaves no half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lengths, ids, held, segment, before = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            packed = write_segment(np.concatenate(names), np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([packed], pa.binary())], names=["segment", "before", "n_ids", "data"])

        for batch in text_chunks(batches, limit=8 * CHUNK_BYTES):
            flat, n = encoder(tokenizer).encode(*flat_bytes(batch.column("text")))
            ends = np.cumsum(n)
            names.append(np.asarray(batch.column("doc_id").fill_null(NULL_ID), dtype=np.int64))
            lengths.append(n + 1)
            ids.append(np.insert(flat, ends, end_id).astype(np.uint16))
            held += len(ids[-1])
            if held >= SEGMENT:
                yield row()
                names, lengths, ids, held, segment, before = [], [], [], 0, segment + 1, before + held
        if names:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "segment int, before long, n_ids long, data binary").withColumn("part", F.spark_partition_id()).write.parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files; start counts the ids of all documents before it."""
    return _read(files, with_ids=True)


def describe_ids(files: DataFrame) -> DataFrame:
    """As read_ids, with ids_crc32 of the ids as little-endian unsigned 32-bit integers in place of the ids."""
    return _read(files, with_ids=False)


def _read(files: DataFrame, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column("before").to_pylist(), batch.column("data"), strict=True):
                doc_ids, lengths, ids = read_segment(data.as_py())
                starts = np.append(0, np.cumsum(lengths))
                columns = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(before + starts[:-1]), pa.array(lengths)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))
                else:
                    plain = memoryview(ids.astype("<u4").tobytes())
                    columns.append(pa.array([zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    # a row for each part, of which write_ids makes no more than its partitions; the writer has counted inside a part
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    shift = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    schema = "doc_id long, start long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long")
    return files.select("part", "before", "data").join(F.broadcast(shift), "part").select((F.col("before") + F.col("shift")).alias("before"), "data").mapInArrow(run, schema)


def encode_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs' ids to files (in the shared folder, if path names none) and describe each document from them.

    Nulls, repeats, long texts, empty tables and clashing names are write_ids's.  Files at a path of the caller's stay;
    those in the shared folder go when the driver ends.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-ids")
    write_ids(docs, path, tokenizer, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return describe_ids(spark.read.parquet(path))
