"""Byte-level BPE in overlapping chunks: pre-tokenise chunks in parallel, stitch them, encode the pieces, decode to bytes.

A text longer than a chunk becomes chunks of STEP + OVERLAP characters, STEP apart, which Spark deals to tasks.  Each is
pre-tokenised from its own first character, so its first boundaries may be wrong.  Where the text runs on, a pre-token
depends on what begins at its start only: once two neighbours share a boundary in what they overlap in, they share all
later ones.  So a piece reaches from the boundary met with the chunk before to the one met with the chunk behind, and its
pre-tokens are the text's own.  Pieces are encoded in parallel, and a text's ids are gathered in the order of its pieces.
Texts in which some neighbours meet nowhere (a pre-token longer than the overlap) are pre-tokenised whole.

A pre-token's bytes are merged by ranks: of all neighbours whose concatenation has a rank, the lowest one first, and of
equal ones the leftmost.  The distinct pre-tokens of a batch are merged side by side, a matrix for each length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, free_names, numbered, text_chunks

#: Characters from one chunk to the next, and those that neighbours share.
STEP, OVERLAP = 16_384, 512
#: How many characters behind a pre-token may still change where it ends: a contraction's three, or a blank and what follows.
LOOK = 4
#: Pre-tokens of more bytes are merged with a heap.
WIDE = 48
#: Pre-tokens whose ids a worker keeps.
KEPT = 250_000
#: Characters of text that one call encodes.
SLICE = 2 << 20

NONE = np.int64(1 << 40)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """The ranks of byte strings, and of two tokens' concatenation."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens
        self.single = np.full(256, -1, dtype=np.int64)
        texts = [b""] * (max(tokens.values()) + 1)
        for text, rank in tokens.items():
            texts[rank] = text
            if len(text) == 1:
                self.single[text[0]] = rank
        if (self.single < 0).any():
            raise ValueError("every byte needs a rank of its own")
        self.ends = np.cumsum([len(t) for t in texts])
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.keys: np.ndarray | None = None  # the table of pairs, which decoding doesn't need

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as file:
            return cls({base64.b64decode(text): int(rank) for text, rank in map(bytes.split, filter(bytes.strip, file))})

    def _table(self) -> None:
        """All pairs whose concatenation has a rank, in a table of open addressing that is at most half full."""
        found: dict[int, int] = {}
        for text, rank in self.tokens.items():
            for i in range(1, len(text)):
                a, b = self.tokens.get(text[:i]), self.tokens.get(text[i:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        keys, values = np.fromiter(found, np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        del found
        bits = max(int(len(keys) * 4).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.empty = np.uint64((1 << 64) - 1)
        self.keys, self.values = np.full(1 << bits, self.empty), np.full(1 << bits, -1, dtype=np.int32)
        slot = (keys * MULTIPLIER >> self.shift).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == self.empty)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each a's bytes followed by b's, NONE where there is none."""
        if self.keys is None:
            self._table()
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = (keys * MULTIPLIER >> self.shift).astype(np.int64)
        out = np.full(len(keys), NONE)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != self.empty)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def merge_equal(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equally many bytes: their ids (left-aligned) and how many there are."""
        rows, width = raw.shape
        out, count = np.zeros((rows, width), dtype=np.int32), np.zeros(rows, dtype=np.int64)
        ids = self.single[raw]
        rank = self.of_pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
        at = np.arange(rows)
        while len(at):
            width = ids.shape[1]
            here = np.arange(len(at))
            best = rank.argmin(axis=1) if width > 1 else np.zeros(len(at), dtype=np.int64)
            low = rank[here, best] if width > 1 else np.full(len(at), NONE)
            done = low == NONE
            if done.any():
                out[at[done], :width], count[at[done]] = ids[done], width
                at, ids, rank, best, low = at[~done], ids[~done], rank[~done], best[~done], low[~done]
                if not len(at):
                    break
                here = np.arange(len(at))
            place = np.arange(width - 1)
            ids[here, best] = low
            ids = np.take_along_axis(ids, place + (place > best[:, None]), axis=1)
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= best[:, None]), axis=1)
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
            p = best[left]
            rank[left, p - 1] = self.of_pairs(ids[left, p - 1], ids[left, p])
            p = best[right]
            rank[right, p] = self.of_pairs(ids[right, p], ids[right, p + 1])
        return out, count

    def merge_long(self, raw: bytes) -> list[int]:
        """One pre-token of any length: a heap of pairs over a linked list."""
        if raw in self.tokens:
            return [self.tokens[raw]]
        ids = self.single[np.frombuffer(raw, np.uint8)]
        rank = self.of_pairs(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(raw)
        start, stop = list(range(n)), list(range(1, n + 1))  # a token's bytes, by where it begins
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n

        def offer(i: int) -> None:
            j = behind[i]
            if j < n:
                r = self.tokens.get(raw[start[i] : stop[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            j = behind[i] if alive[i] else n
            if j >= n or self.tokens.get(raw[start[i] : stop[j]]) != r:
                continue  # one of the two has been merged since
            ids[i], stop[i], behind[i], alive[j] = r, stop[j], behind[j], False
            if behind[i] < n:
                before[behind[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, a in zip(ids, alive, strict=True) if a]


class Encoder:
    """Ids of texts and pre-tokens, and bytes of ids."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens end to end, and each one's number of them."""
        if len(self.known) > KEPT:
            self.forget()
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.known)) if pieces else []
        if fresh:
            self._learn(fresh)
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        count = self.ends[which + 1] - self.ends[which]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.ends[which] - ends + count, count)
        return self.flat[at], count

    def _learn(self, fresh: list[str]) -> None:
        raw = [p.encode() for p in fresh]
        sizes = np.array([len(r) for r in raw])
        count = np.zeros(len(raw), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # which pre-tokens, and their ids
        whole = np.array([self.ranks.tokens.get(r, -1) for r in raw])
        count[whole >= 0] = 1
        for size in np.unique(sizes[whole < 0]):
            rows = np.flatnonzero((sizes == size) & (whole < 0))
            if size > WIDE:
                for i in rows:
                    ids = np.array(self.ranks.merge_long(raw[i]), dtype=np.int32)
                    count[i] = len(ids)
                    found.append((np.full(len(ids), i), ids))
                continue
            ids, n = self.ranks.merge_equal(np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8).reshape(len(rows), size))
            count[rows] = n
            found.append((np.repeat(rows, n), ids[np.arange(size) < n[:, None]]))
        ones = np.flatnonzero(whole >= 0)
        found.append((ones, whole[ones].astype(np.int32)))
        owner = np.concatenate([o for o, _ in found])
        flat = np.concatenate([i for _, i in found])[np.argsort(owner, kind="stable")]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(count))
        self.flat = np.append(self.flat, flat)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts end to end, and each one's number of them."""
        found = [self.find(t) for t in texts]
        ids, count = self.pieces([p for f in found for p in f])
        ends = np.append(0, np.cumsum(count))[np.append(0, np.cumsum([len(f) for f in found]))]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' bytes end to end, and their offsets."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ranks.ends)):
            raise ValueError("an id beyond the vocabulary")
        stop = self.ranks.ends[ids]
        count = stop - np.append(0, self.ranks.ends)[ids]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(stop - ends, count)
        return self.ranks.flat[at], np.append(0, ends)[np.append(0, np.cumsum(lengths))]


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, with the pre-tokens it has met."""
    return Encoder(Ranks.load(path), pattern)


def lists(ids: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))


def _encode_whole(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """df with the ids of whole texts."""
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text, limit=SLICE):
            ids, count = encoder(path, pattern).texts([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(ids, count)], names=[*names, "ids"])

    return df.mapInArrow(run, schema)


def chunks_of(long: DataFrame, text: str, step: int, overlap: int) -> DataFrame:
    """(row, k, last, chunk) of each text, several chunks at a time."""
    schema = "row long, k int, last boolean, chunk string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, whole in zip(batch.column("row").to_pylist(), batch.column(text).to_pylist(), strict=True):
                n = max(1, -(-(len(whole) - overlap) // step))
                for first in range(0, n, 64):
                    ks = range(first, min(first + 64, n))
                    parts = [whole[k * step : k * step + step + overlap] for k in ks]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(ks), pa.int64()), pa.array(ks, pa.int32()), pa.array([k == n - 1 for k in ks]), pa.array(parts, pa.string())], names=["row", "k", "last", "chunk"])

    return long.select("row", text).mapInArrow(run, schema)


def pretokenised(chunks: DataFrame, pattern: str, step: int, overlap: int) -> DataFrame:
    """chunks with the sizes of their pre-tokens in characters, and where neighbours may meet.

    heads are boundaries in what a chunk shares with the one before, its own beginning among them; tails those in what it
    shares with the one behind, counted from where that one begins, that the chunk's end can't have changed.
    """
    added = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("sizes", "heads", "tails")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in text_chunks(batches, "chunk", limit=SLICE):
            sizes = [np.fromiter(map(len, find(c)), np.int32) for c in batch.column("chunk").to_pylist()]
            ends = [np.cumsum(s) for s in sizes]
            heads = [np.append(0, e[e <= overlap]) for e in ends]
            tails = [e[(e >= step) & (e <= step + overlap - LOOK)] - step for e in ends]
            arrays = [lists(np.concatenate(x).astype(np.int32), np.array([len(s) for s in x])) for x in (sizes, heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "sizes", "heads", "tails"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, *added]))


def seams(marked: DataFrame, step: int) -> DataFrame:
    """(row, k, start, stop, whole): the piece of each chunk, or whole where some neighbours of the row meet nowhere."""
    near = W.partitionBy("row").orderBy("k")
    ends = marked.select("row", "k", "last", F.char_length("chunk").alias("size"), "heads", F.when(~F.col("last"), F.col("tails")).alias("tails"))
    met = ends.withColumn("meet", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tails").over(near), "heads"))))
    stop = F.when(F.col("last"), F.col("size")).otherwise(F.lead("meet").over(near) + step)
    lost = F.max(F.col("meet").isNull()).over(W.partitionBy("row"))
    return met.select("row", "k", F.col("meet").alias("start"), stop.alias("stop"), lost.alias("whole"))


def _encode_pieces(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """(row, k, ids) of (row, k, chunk, sizes, start, stop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "chunk", limit=SLICE):
            tool, parts, sizes = encoder(path, pattern), [], []
            for chunk, size, start, stop in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "start", "stop")), strict=True):
                bounds = [start, *(e for e in accumulate(size) if start < e <= stop)]
                parts += [chunk[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905 - one shorter
                sizes.append(len(bounds) - 1)
            ids, count = tool.pieces(parts)
            n = np.diff(np.append(0, np.cumsum(count))[np.append(0, np.cumsum(sizes))])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), lists(ids, n)], names=["row", "k", "ids"])

    return pieces.select("row", "k", "chunk", "sizes", "start", "stop").mapInArrow(run, "row long, k int, ids array<int>")


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """docs with ids and n_ids; names that docs has already get underscores, so no column is lost.

    path names a file of ranks, pattern what a pre-token is.  A null or empty text has no ids, repeated rows are encoded
    alike, and nulls in other columns stay.  Texts of more than step + overlap characters go through overlapping chunks,
    whatever their length; the ids of a text are one array.  Equal ranks merge from the left.  An empty table stays empty.
    """
    if not overlap + LOOK <= step:
        raise ValueError("chunks must be longer than what they share")
    plain, names = numbered(docs)
    body = names[text]
    long = F.coalesce(F.char_length(body) > step + overlap, F.lit(False))
    kept = cut(plain.where(long).withColumn("row", F.monotonically_increasing_id()))  # row numbers stay as they were written
    marked = cut(pretokenised(chunks_of(kept, body, step, overlap).repartition("row", "k"), pattern, step, overlap))
    pieces = cut(seams(marked, step))
    encoded = _encode_pieces(marked.join(pieces.where("not whole"), ["row", "k"]), path, pattern)
    gathered = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("row", F.flatten(F.col("parts.ids")).alias("ids"))
    stray = kept.join(pieces.where("whole").select("row").distinct(), "row", "left_semi").drop("row")
    out = _encode_whole(plain.where(~long), body, path, pattern).unionByName(kept.join(gathered, "row").drop("row")).unionByName(_encode_whole(stray, body, path, pattern))
    return out.withColumn("n_ids", F.size("ids").cast("long")).toDF(*docs.columns, *free_names(docs, "ids", "n_ids"))


def decode_column(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """docs with the raw bytes that ids stand for in column decoded; null ids give null, no ids empty bytes.

    Bytes are concatenated as they are, so they need not be UTF-8 unless ids are a whole text's.  A null or an unknown id
    in a list raises.  Repeated rows are decoded alike, an empty table stays empty, a column named decoded stays beside.
    """
    plain, names = numbered(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(names[ids])
            flat = rows.flatten()
            if flat.null_count:
                raise ValueError("a null among ids")
            count = np.asarray(rows.value_lengths().fill_null(0), dtype=np.int64)
            data, offsets = encoder(path, pattern).decode(np.asarray(flat, dtype=np.int64), count)
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
            if rows.null_count:
                decoded = pa.compute.if_else(rows.is_valid(), decoded, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*names.values(), "decoded"])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, *free_names(docs, "decoded"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids of every text, and the bytes that they decode to."""
    texts = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"))
    done = decode_column(encode_column(texts, path, pattern).select("doc_id", "ids", "n_ids"), path, pattern)
    return done.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
