"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct 5-word shingles.  Two sets link when 100 * intersection >= 75 * union, that is when
they differ in at most (|A| + |B|) / 7 elements.  The steps:

1. Shingles are counted over all documents.  Three quarters of a linking set's elements occur in another document, so
   the rest of the documents link with nothing.  Only this exact test sees all shingles, packed by hash range.
2. Equal sets collapse into one.
3. Sets fall into bands of sizes lo to 4/3 lo; linking sets are in the same band or in adjacent ones.  PartEnum hashes
   the domain into n1 first-level parts of n2 second-level parts (`partition`: for up to four differences one part of
   k + 3, beyond them high / 3 parts of 3 of which 1 may differ); sets of a band with at most k differences differ in
   at most k2 second-level parts of some first-level part, so they agree on one subset of n2 - k2 of its parts.  Each
   subset's content is a signature.  Empty subsets aren't signatures.  Two sets share all signatures but those that
   differences cost, the first difference in a part most.  A set for which that may be all keeps all its signatures, by
   which it meets those for which it isn't, and has its elements as signatures besides, by which such sets meet.
4. Of its signatures a set keeps the rarest that suffice: the others are more than the guarantee needs.  So a passage
   that many documents share makes no candidates unless it is most of a document.
5. Sets that share a signature are candidates, chained by the smallest set of the signature's.  Each chain is searched
   exactly, without going through its pairs: breadth first, over an inverted index of what isn't reached yet.  Of
   chains too large for one task every set is first compared with one other, which joins dense groups; then the chain
   is dealt to blocks, and those pairs of blocks that may hold another link are searched in the same way.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import C1, components, cut, edges_of, flat_bytes, hot_join, input_bytes, mix, text_chunks, words

N = 5
#: Chains of at most so many sets and elements are searched in one task.
CHAIN_SETS, CHAIN_ELEMENTS = 4096, 4_000_000
#: Text bytes whose shingles one task counts at a time.
BUCKET_BYTES = 64 << 20
NO_ID = -(1 << 63)

_PLACE = mix((np.arange(N, dtype=np.uint64) + np.uint64(17)) * C1) | np.uint64(1)
_SHORT = mix((np.arange(N, dtype=np.uint64) + np.uint64(99)) * C1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every 5-word shingle, repeats too; rows with one to four words have them all as one."""
    w, firsts = words(data, offsets)
    counts = np.diff(firsts)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    if len(w) >= N:
        h = np.zeros(len(w) - N + 1, np.uint64)
        for j in range(N):
            h += w[j : len(w) - N + 1 + j] * _PLACE[j]
        whole = row[: len(h)] == row[N - 1 :]
        rows, hashes = [row[: len(h)][whole]], [mix(h[whole])]
    else:
        rows, hashes = [], []
    for c in range(1, N):
        at = np.flatnonzero(counts == c)
        if len(at):
            h = np.full(len(at), _SHORT[c])
            for j in range(c):
                h += w[firsts[at] + j] * _PLACE[j]
            rows.append(at.astype(np.int32))
            hashes.append(mix(h))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set, ordered by hash and then row."""
    order = np.lexsort((row, h))
    row, h = row[order], h[order]
    if len(h):
        fresh = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        row, h = row[fresh], h[fresh]
    return row, h


def fingerprints(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Sixteen bytes for each of n rows' sets; row is ascending.  Equal sets, equal bytes."""
    out = np.zeros((n, 2), np.uint64)
    if len(row):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[starts], 0] = np.add.reduceat(mix(h + C1), starts)
        out[row[starts], 1] = np.add.reduceat(mix(h ^ C1), starts)
    return out


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _counting(buckets: int):
    """Of each chunk: one row of what is known of its documents, and a row for each bucket of hashes to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << 32
        for number, batch in enumerate(text_chunks(batches)):
            ids = np.asarray(batch.column("doc_id").fill_null(NO_ID), dtype=np.int64)
            row, h = distinct(*shingles(*flat_bytes(batch.column("text"))))
            same = h[1:] == h[:-1]
            local = np.zeros(len(h), bool)  # known to be in two documents
            local[1:] |= same
            local[:-1] |= same
            size = np.bincount(row, minlength=len(ids))
            shared = np.bincount(row[local], minlength=len(ids))
            by_row = np.argsort(row.astype(np.uint16), kind="stable")
            prints = fingerprints(row[by_row], h[by_row], len(ids))
            known = np.concatenate([x.astype(np.int64).view(np.uint8) for x in (ids, size, shared, prints.view(np.int64).reshape(-1))]).tobytes()
            # the others ask; hashes met twice here only tell, once
            ask = by_row[~local[by_row]]
            bucket = (h[ask] >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            ask, bucket = ask[order], bucket[order].astype(np.int64)
            tell = h[local & np.append(True, ~same)] if len(h) else h
            tell_bucket = (tell >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(tell_bucket, kind="stable")
            tell, tell_bucket = tell[order], tell_bucket[order].astype(np.int64)
            key, told = (h[ask] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (tell & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            present = np.union1d(bucket, tell_bucket)
            edges, told_edges = (np.append(np.searchsorted(x, present), len(x)).tolist() for x in (bucket, tell_bucket))
            chunk = task + number
            out = ([chunk % buckets], [known], [b""], [b""])
            for i, b in enumerate(present.tolist()):
                part = slice(edges[i], edges[i + 1])
                for column, value in zip(out, (b, _rows(row[ask[part]], len(ids)), key[part].tobytes(), told[told_edges[i] : told_edges[i + 1]].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([chunk] * len(out[0]), pa.int64()), pa.array([True] + [False] * (len(out[0]) - 1)), _binary(out[1]), _binary(out[2]), _binary(out[3])], names=["bucket", "chunk", "known", "a", "b", "c"])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """For each chunk that asked: how many of a document's hashes in this bucket are in another document."""
    group = group.combine_chunks()
    known, chunk = group["known"].to_pylist(), group["chunk"]
    a, b, c = (group[x] for x in "abc")
    asks = [i for i, k in enumerate(known) if not k]
    empty = np.zeros(0, np.uint32)
    keys = [np.frombuffer(b[i].as_py(), np.uint32) for i in asks]
    told = [np.frombuffer(c[i].as_py(), np.uint32) for i in asks]
    every = np.concatenate([*keys, *told, *told, empty])
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    payload = [a[i].as_py() if known[i] else b"" for i in range(len(known))]
    for i, key in zip(asks, keys, strict=True):
        raw = a[i].as_py()
        yes = np.zeros(len(key), bool)
        if len(twice):
            yes = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
        if raw[-1:] == SPARSE:
            payload[i] = np.frombuffer(raw, np.uint16, len(key))[yes].tobytes() + SPARSE
            continue
        lens = np.frombuffer(raw, np.uint32, len(raw) // 4).astype(np.int64)
        sums = np.append(0, np.cumsum(yes))
        ends = np.cumsum(lens)
        payload[i] = (sums[ends] - sums[ends - lens]).astype(np.uint32).tobytes() + DENSE
    return pa.table([chunk, group["known"], _binary(payload)], names=["chunk", "known", "payload"])


# Which of a chunk's documents hashes belong to: how many are each document's, or, if that is longer, each one's document.
DENSE, SPARSE = b"\0", b"\1"


def _rows(row: np.ndarray, n: int) -> bytes:
    """row is ascending and below n, which is below 2 ** 16."""
    if len(row) < 2 * n:
        return row.astype(np.uint16).tobytes() + SPARSE
    return np.bincount(row, minlength=n).astype(np.uint32).tobytes() + DENSE


def _documents(group: pa.Table) -> pa.Table:
    known = group["known"].to_pylist()
    payload = group["payload"].to_pylist()
    fields = np.frombuffer(payload[known.index(True)], np.int64)
    n = len(fields) // 5
    ids, size, shared, prints = fields[:n], fields[n : 2 * n], fields[2 * n : 3 * n].copy(), fields[3 * n :].reshape(n, 2)
    for k, p in zip(known, payload, strict=True):
        if not k and p[-1:] == SPARSE:
            shared += np.bincount(np.frombuffer(p, np.uint16, len(p) // 2), minlength=n)
        elif not k:
            shared += np.frombuffer(p, np.uint32, len(p) // 4)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())
    return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(size), pa.array(shared), raw], names=["doc_id", "n_shingles", "n_shared", "set"])


def count_shingles(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, n_shared, set): n_shared, of the set's elements, are in another row too, or seem so by a 32-bit collision."""
    buckets = buckets or max(64, math.ceil(input_bytes(docs) / BUCKET_BYTES))
    asked = docs.mapInArrow(_counting(buckets), "bucket int, chunk long, known boolean, a binary, b binary, c binary")
    told = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, known boolean, payload binary")
    return told.groupBy("chunk").applyInArrow(_documents, "doc_id long, n_shingles long, n_shared long, set binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, n, elements) of each document: sorted 64-bit hashes end to end."""
    for batch in text_chunks(batches):
        row, h = distinct(*shingles(*flat_bytes(batch.column("text"))))
        order = np.argsort(row.astype(np.uint16), kind="stable")
        row, h = row[order], h[order]
        n = np.bincount(row, minlength=batch.num_rows)
        prints = fingerprints(row, h, batch.num_rows)
        offsets = np.append(0, np.cumsum(n * 8)).astype(np.int64)
        elements = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(h))]).cast(pa.binary())
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([raw, pa.array(n.astype(np.int64)), elements, pa.array(np.ascontiguousarray(prints[:, 0]).view(np.int64))], names=["set", "n", "elements", "key"])


# --- signatures ---------------------------------------------------------------------------------------------------


def bands(up_to: int) -> np.ndarray:
    """The lowest size of each band, and one past the last."""
    out = [1]
    while out[-1] <= up_to:
        out.append(out[-1] * 4 // 3 + 1)
    return np.array(out)


def partition(high: int) -> tuple[int, int, int]:
    """(n1, n2, k2) of a band whose largest size is high; its sets may differ in differences(high) elements."""
    k = differences(high)
    return (1, k + 3, k) if k <= 4 else (max(k // 2 + 2, high // 3), 3, 1)


def differences(high: int) -> int:
    return 2 * high // 7


@lru_cache(maxsize=64)
def _subsets(n2: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every choice of size second-level parts, and a salt for each."""
    chosen = np.array(list(itertools.combinations(range(n2), size)))
    return chosen, mix((np.arange(len(chosen), dtype=np.uint64) + np.uint64(3)) * C1)


def signatures(elements: np.ndarray, band: int, high: int) -> tuple[np.ndarray, int]:
    """A set's signatures in a band, and how many of them are more than the guarantee needs (below 0: it doesn't hold)."""
    n1, n2, k2 = partition(high)
    salt = np.uint64((band + 1) * int(C1) & 0xFFFFFFFFFFFFFFFF)
    first, second = (elements >> np.uint64(7)) % np.uint64(n1), mix(elements + salt) % np.uint64(n2)
    cell = (first * np.uint64(n2) + second).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], mix(elements[order] + salt)
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    content, filled = np.zeros((n1, n2), np.uint64), np.zeros((n1, n2), bool)
    content.ravel()[cell[starts]], filled.ravel()[cell[starts]] = np.add.reduceat(value, starts) if len(starts) else value, True
    chosen, salts = _subsets(n2, n2 - k2)
    token = content[:, chosen].sum(axis=2, dtype=np.uint64) + salts + (np.arange(n1, dtype=np.uint64) * C1 + salt)[:, None]
    token = mix(token[filled[:, chosen].any(axis=2)])
    # the d-th difference in a part costs the subsets that hold it and not those before it: the first cost most
    many, left, lost = filled.sum(axis=1), differences(high), 0
    for d in range(1, n2 + 1):
        here = min(left, int((many >= d).sum()))
        left, lost = left - here, lost + here * math.comb(n2 - d, n2 - k2 - 1)
    return token, len(token) - lost - 1


def entries(elements: np.ndarray, band: int, high: int) -> Iterator[tuple[np.ndarray, int]]:
    """A set's signatures in a band, each list with how many of it must be kept."""
    token, spare = signatures(elements, band, high)
    token = np.unique(token)
    yield token, len(token) - max(spare, 0)
    if spare < 0:
        yield mix(elements ^ mix(np.full(1, band + 0x5EED, np.uint64))), min(differences(high) + 1, len(elements))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray]]:
    for batch in batches:
        for s, e in zip(batch.column("set").to_pylist(), batch.column("elements"), strict=True):
            yield s, np.frombuffer(e.as_buffer(), np.uint64)


def _home(lows: np.ndarray, n: int) -> list[int]:
    b = int(np.searchsorted(lows, n, side="right")) - 1
    return [b, b + 1]


def _signing(buckets: int):
    """Of each chunk of sets: a row that names them, and a row for each bucket of signatures to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << 32
        for number, batch in enumerate(text_chunks(batches, "elements")):
            key, keep, total, tokens = [], [], [], [np.zeros(0, np.uint64)]
            for s, elements in _each(iter([batch])):
                lows = bands(2 * len(elements) + 2)
                for b in _home(lows, len(elements)):
                    high = int(lows[b + 1]) - 1
                    # without a difference sets are equal; one too small for the band's larger sets has the smaller ones in its own
                    if not 0 < differences(high) < len(elements):
                        continue
                    for token, needed in entries(elements, b, high):
                        key.append(int.from_bytes(s[:8], "little", signed=True))
                        total.append(len(token))
                        keep.append(needed)
                        tokens.append(token)
            token = np.concatenate(tokens)
            row = np.repeat(np.arange(len(key), dtype=np.uint32), total)
            bucket = ((token >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, row, low = bucket[order], row[order], (token[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            present, edges = edges_of(bucket)
            chunk = task + number
            out = ([chunk % buckets], [np.array([key, keep, total], np.int64).tobytes()], [b""])
            row = row.astype(_kind(len(key)))
            for b, x, y in zip(present.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for column, value in zip(out, (b, row[x:y].tobytes(), low[x:y].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([chunk] * len(out[0]), pa.int64()), pa.array([True] + [False] * (len(out[0]) - 1)), _binary(out[1]), _binary(out[2])], names=["bucket", "chunk", "known", "a", "b"])

    return run


def _kind(n: int) -> type:
    """What holds the numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.uint32


#: What a signature in more sets than this counts as; among such ones the order is by signature alone.
MOST = (1 << 16) - 1


def _frequent(group: pa.Table) -> pa.Table:
    """For each chunk that asked: which of its signatures in this bucket are in two sets or more, and in how many."""
    known, chunk, bucket = group["known"].to_pylist(), group["chunk"], group["bucket"]
    a, b = group["a"].to_pylist(), group["b"].to_pylist()
    low = [np.frombuffer(x, np.uint32) for x in b]
    _, place, count = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    df, at = np.minimum(count, MOST).astype(np.uint16)[place], 0
    out = []
    for i, k in enumerate(known):
        n = len(low[i])
        met, mine = df[at : at + n] > 1, df[at : at + n]
        at += n
        if k:
            out.append(a[i])
        else:
            row = np.frombuffer(a[i], np.uint16 if len(a[i]) == 2 * n else np.uint32)[met]
            out.append(low[i][met].tobytes() + mine[met].tobytes() + row.tobytes())
    return pa.table([chunk, group["known"], bucket, _binary(out)], names=["chunk", "known", "bucket", "payload"])


def _keep(group: pa.Table) -> pa.Table:
    """(bucket, key, token) of the signatures that a chunk's sets keep: the rarest, of which those of one set alone come first."""
    known, payload, buckets = group["known"].to_pylist(), group["payload"].to_pylist(), group["bucket"].to_pylist()
    key, keep, total = np.frombuffer(payload[known.index(True)], np.int64).reshape(3, -1)
    width = np.dtype(_kind(len(key))).itemsize
    token, df, row = ([np.zeros(0, t)] for t in (np.int64, np.uint16, np.int64))
    for k, bucket, x in zip(known, buckets, payload, strict=True):
        if not k:
            n = len(x) // (6 + width)
            token.append(np.frombuffer(x, np.uint32, n).astype(np.int64) | np.int64(bucket) << 32)
            df.append(np.frombuffer(x, np.uint16, n, 4 * n))
            row.append(np.frombuffer(x, _kind(len(key)), n, 6 * n).astype(np.int64))
    token, df, row = (np.concatenate(x) for x in (token, df, row))
    order = np.lexsort((token, df, row))
    row, token = row[order], token[order]
    n = np.bincount(row, minlength=len(key))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    kept = rank < (keep - (total - n))[row]
    row, token = row[kept], token[kept]
    order = np.argsort(token >> 32, kind="stable")  # by bucket and then by set
    row, token = row[order], token[order]
    present, edges = edges_of(token >> 32)
    parts = [slice(x, y) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    low = (token & 0xFFFFFFFF).astype(np.uint32)
    return pa.table([pa.array(present, pa.int32()), _binary([key[row[x]].tobytes() for x in parts]), _binary([low[x].tobytes() for x in parts])], names=["bucket", "key", "token"])


def _pivots(group: pa.Table) -> pa.Table:
    """(key, pivot, n): each set with the smallest that shares a signature in this bucket, and by how many of them."""
    key = np.concatenate([np.frombuffer(x, np.int64) for x in group["key"].to_pylist()])
    token = np.concatenate([np.frombuffer(x, np.uint32) for x in group["token"].to_pylist()])
    order = np.lexsort((key, token))
    key, token = key[order], token[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    pivot = np.repeat(key[first], np.diff(np.append(first, len(key))))
    other = key != pivot
    pair, n = np.unique(np.stack([key[other], pivot[other]]), axis=1, return_counts=True)
    return pa.table([pa.array(pair[0]), pa.array(pair[1]), pa.array(n, pa.int64())], names=["key", "pivot", "n"])


def candidates(sets: DataFrame, buckets: int) -> DataFrame:
    """(key, pivot, shared): each set with the smallest that shares a kept signature, and how many they have that way.

    key is the first 8 bytes of a set's fingerprint.  Should two sets' be alike, they only become candidates.
    """
    asked = sets.select("set", "elements").mapInArrow(_signing(buckets), "bucket int, chunk long, known boolean, a binary, b binary")
    told = asked.groupBy("bucket").applyInArrow(_frequent, "chunk long, known boolean, bucket int, payload binary")
    kept = told.groupBy("chunk").applyInArrow(_keep, "bucket int, key binary, token binary")
    met = kept.groupBy("bucket").applyInArrow(_pivots, "key long, pivot long, n long")
    return met.groupBy("key", "pivot").agg(F.sum("n").alias("shared"))


def possible_ids(ids: DataFrame, n: int, most_bits: int = 1 << 28):
    """A Bloom filter of n ids, of 16 bits each and most_bits at most: what it lets through besides does no harm."""
    bits = min(most_bits, 1 << max(16, math.ceil(math.log2(16 * n + 1))))
    places = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)) for i in range(3)])).alias("p"))
    held = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).toArrow()
    words_ = np.zeros(bits // 64, np.int64)
    words_[np.asarray(held["w"])] = np.asarray(held["v"])
    return ids.sparkSession.sparkContext.broadcast(words_), bits


def possible(ids: DataFrame, id_: Column) -> Column:
    """Whether id_ is one of ids (doc_id), or seems so by the filter."""
    words_, bits = possible_ids(ids, ids.count())

    @F.arrow_udf("boolean")
    def held(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        at = np.stack([np.asarray(x) for x in (a, b, c)])
        return pa.array((words_.value[at >> 6] >> (at & 63) & 1).astype(bool).all(axis=0))

    return held(*[F.pmod(F.xxhash64(id_.cast("long"), F.lit(i)), F.lit(bits)) for i in range(3)])


# --- exact search -------------------------------------------------------------------------------------------------


def link_components(sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The link component of each of several sets, elements end to end; a component's number is its first set's.

    Breadth first: a reached set is compared with all that aren't reached, through an index of their elements.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(flat, return_inverse=True)
    starts = np.append(0, np.cumsum(sizes))
    out = np.full(n, -1)
    free = np.ones(n, bool)
    indexed = 0

    def index() -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(free[owner])
        order = np.argsort(code[rows], kind="stable")
        return owner[rows][order], np.append(0, np.cumsum(np.bincount(code[rows], minlength=int(code.max()) + 1 if len(code) else 1)))

    posting, edge = index()
    indexed = n
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed], out[seed], queue = False, seed, [seed]
        while queue:
            x = queue.pop()
            left = int(free.sum())
            if not left:
                break
            if left < indexed // 2:
                posting, edge = index()
                indexed = left
            mine = code[starts[x] : starts[x + 1]]
            lens = edge[mine + 1] - edge[mine]
            at = np.repeat(edge[mine] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(int(lens.sum()))
            met = np.bincount(posting[at], minlength=n)
            linked = np.flatnonzero(free & (100 * met >= 75 * (sizes[x] + sizes - met)) & (met > 0))
            free[linked], out[linked] = False, seed
            queue += linked.tolist()
        for x in queue:  # nothing was left to reach
            out[x] = seed
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, first) for each chain; rows come ordered by chain and set, and a set may come several times."""
    held: list[tuple[bytes, np.ndarray]] = []
    chain = None

    def solve() -> pa.RecordBatch:
        group = link_components(np.array([len(e) for _, e in held]), np.concatenate([e for _, e in held]))
        return pa.RecordBatch.from_arrays([_binary([s for s, _ in held]), _binary([held[g][0] for g in group])], names=["set", "first"])

    for batch in batches:
        for c, (s, e) in zip(batch.column("component").to_pylist(), _each(iter([batch])), strict=True):
            if c != chain and held:
                yield solve()
                held = []
            chain = c
            if not held or held[-1][0] != s:
                held.append((s, e.copy()))
    if held:
        yield solve()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (x, y) with met, the size of the intersection, and both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, f = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("e", "f"))
            met = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(e, f, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(met, pa.int64()), pa.array([len(p) for p in e], pa.int64()), pa.array([len(q) for q in f], pa.int64())], names=["x", "y", "met", "nx", "ny"])

    left, right = sets.select(F.col("set").alias("x"), F.col("elements").alias("e")), sets.select(F.col("set").alias("y"), F.col("elements").alias("f"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "e", "f").mapInArrow(run, "x binary, y binary, met long, nx long, ny long")


LINKED = "100 * met >= 75 * (nx + ny - met)"


def _across(edges: DataFrame, sets: DataFrame, placed: DataFrame, chain_sets: int, chain_elements: int) -> DataFrame:
    """Links (a, b), enough of them to join all that are linked, inside chains too large for one task.

    edges is candidates', placed (key, component) names the chains.  Every set is compared with the pivot it shares most
    signatures with.  Then each chain is dealt to blocks of half a task's size by group, if the pivots have made a large one, by
    size of the sets and by hash, and pairs of blocks are searched whole; not those of one large group, nor those whose sizes differ too
    much for a link.  So a set travels once for each block that may hold a link of its own.
    """
    few = placed.count() * 64 <= 32 << 20
    mine = cut(sets.join(F.broadcast(placed) if few else placed, "key"))
    name = mine.select("key", "set").distinct()
    near = edges.groupBy("key").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot"))
    near = near.join(name.withColumnRenamed("set", "x"), "key").join(name.select(F.col("key").alias("pivot"), F.col("set").alias("y")), "pivot")
    links = cut(_verify(near.select("x", "y"), mine).where(LINKED).select(F.col("x").alias("a"), F.col("y").alias("b")))
    label = components(links).select(F.col("node").alias("set"), F.col("component").alias("label"))
    members = cut(mine.select("component", "set", "n").distinct().join(label, "set", "left"))
    large = members.where("label is not null").groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("e"))
    large = large.where(f"16 * c > {int(chain_sets)} or 16 * e > {int(chain_elements)}").select("label", F.col("label").alias("part"))
    members = members.join(large, "label", "left").withColumn("scale", F.floor(F.log("n") / math.log(4 / 3)))
    group = ["component", "part", "scale"]
    parts = F.ceil(F.greatest(2 * F.count("*") / F.lit(chain_sets), 2 * F.sum("n") / F.lit(chain_elements))).cast("int")
    groups = members.groupBy(*group).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), parts.alias("parts"))
    blocks = cut(groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.monotonically_increasing_id()))
    i, j = (blocks.select("component", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "part", "lo", "hi")]) for x in "ij")
    apart = "block_i <= block_j and (part_i is null or part_j is null or part_i <> part_j) and 100 * hi_i >= 75 * lo_j and 100 * hi_j >= 75 * lo_i"
    pairs = cut(i.join(j, "component").where(apart).select("block_i", "block_j").withColumn("pair", F.monotonically_increasing_id()))
    ends = pairs.select("pair", F.explode(F.array_distinct(F.array("block_i", "block_j"))).alias("block"))
    sizes = groups.select(*[F.col(c).alias(f"{c}_") for c in (*group, "parts")])
    same = (F.col("component") == F.col("component_")) & F.col("part").eqNullSafe(F.col("part_")) & (F.col("scale") == F.col("scale_"))
    dealt = members.join(sizes, same).select(*group, "set", F.pmod(F.xxhash64("set"), F.col("parts_")).cast("int").alias("deal"))
    at = blocks.select(*[F.col(c).alias(f"{c}_") for c in (*group, "deal")], "block")
    going = cut(dealt.join(at, same & (F.col("deal") == F.col("deal_"))).select("set", "block").join(ends, "block").select("set", F.col("pair").alias("component")))
    every = mine.select("set", "elements").join(F.broadcast(going) if few and going.count() * 64 <= 32 << 20 else going, "set")
    found = every.select("component", "set", "elements").repartition("component").sortWithinPartitions("component", "set").mapInArrow(_search, "set binary, first binary")
    return links.union(found.where("set <> first"))


def jaccard_join(docs: DataFrame, chain_sets: int = CHAIN_SETS, chain_elements: int = CHAIN_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: the smallest doc_id reachable by links.

    Rows are told apart by their sets, so rows repeated under one doc_id are each answered.  A null or blank text has
    an empty set and links with nothing: its component is its own doc_id.  A null doc_id never is a component's name
    unless the component has no other, and then the name is null.  Texts are whole; no link is lost.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = cut(count_shingles(docs))
    may = counted.where("n_shingles > 0 and 100 * n_shared >= 75 * n_shingles")
    one = may.groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    expected = one.count()
    words_, bits = possible_ids(one, expected)
    places = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)) for i in range(3)])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("at").flatten())
            yes = (words_.value[at >> 6] >> (at & 63) & 1).reshape(-1, 3).all(axis=1)
            yield from _sets(iter([batch.filter(pa.array(yes)).select(["text"])]))

    made = docs.select("text", places.alias("at")).mapInArrow(some, "set binary, n long, elements binary, key long").where("n > 0")
    sets = cut(made.select("set", "key", "n", "elements"))
    if sets.count() > 2 * expected:  # rows of one id, or none: the filter lets all of their copies through
        sets = cut(sets.groupBy("set", "key").agg(F.first("n").alias("n"), F.first("elements").alias("elements")))
    edges = cut(candidates(sets, max(64, math.ceil(input_bytes(docs) / BUCKET_BYTES))))
    chains = components(edges, "key", "pivot").withColumnRenamed("node", "key")
    sized = chains.join(sets.select("key", "n"), "key")
    extent = sized.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("e"))
    small = f"c <= {int(chain_sets)} and e <= {int(chain_elements)}"
    placed = cut(chains.join(extent, "component"))
    near = placed.where(small).select("key", "component").join(sets.select("set", "key", "elements"), "key").drop("key")
    found = near.repartition("component").sortWithinPartitions("component", "set").mapInArrow(_search, "set binary, first binary")
    large = placed.where(f"not ({small})").select("key", "component")
    if not large.isEmpty():
        far = components(_across(edges, sets, large, chain_sets, chain_elements)).select(F.col("node").alias("set"), F.col("component").alias("first"))
        found = found.union(far)
    found = cut(found)  # what follows reads it twice
    times = may.groupBy("set").agg(F.count("*").alias("times"))
    grouped = hot_join(may, times.join(found, "set", "left").select("set", F.coalesce("first", "set").alias("first"), "times"), "set", "times")
    grouped = cut(grouped.select("doc_id", "n_shingles", "first"))
    names = grouped.groupBy("first").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("times"))
    linked = hot_join(grouped, names, "first", "times").select("doc_id", "n_shingles", "component_id")
    alone = counted.where("not (n_shingles > 0 and 100 * n_shared >= 75 * n_shingles)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)
