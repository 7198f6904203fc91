"""Spelling variants: pairs of words one edit apart, from a positional index of q-grams with a count filter.

Words come from whole texts and are counted in tasks first.  A word's grams are the Q letters at each place, with Q - 1
blanks around the word; one edit destroys at most Q of them, so two words one edit apart share all but Q of the longer
one's, at the same place or, behind an insertion, one place later.  Hence they share one of each word's Q + 1 rarest grams
(rarest by one order for all words), and only these are posted.  Postings are keyed by gram and length, so a word meets
postings of its own length and of the next one.  In a task a word's postings of one gram are a run of places, and the runs
of all its grams there are merged; each candidate is counted, the count filter keeps those with enough grams in common,
and these are verified letter by letter.  A key with many postings is dealt to several tasks, block against block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, edges_of, flat_bytes, text_chunks

#: Letters of a gram: a gram's letters are bytes of Latin-1 and the gram a 32-bit number.
Q = 4
#: Words have at least so many letters and occurrences.
LEAST_LETTERS, LEAST_TIMES = 6, 5
#: A run in a document of which the hash is divisible by this loses a letter.
SLIP = 199
#: A word's form occurs at least so many times as often.
FORM_TIMES = 5
#: Distinct words that a task counts before it hands them on.
HELD = 500_000
#: Grams are ordered by how often their bucket occurs; so many buckets bound what the driver and each task hold.
BUCKETS = 1 << 18
#: Postings of one key that one task takes; more are dealt in blocks.
BLOCK = 20_000
#: Postings and candidate pairs that are held at once in a task.
ROWS, PAIRS = 200_000, 1 << 20
#: Words up to so many bytes have their checksums from tables.
TABLE_BYTES = 64

ASCII = np.zeros(256, dtype=bool)
ASCII[65:91] = ASCII[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _shift_tables() -> np.ndarray:
    """For n up to TABLE_BYTES: what n further zero bytes make of a crc32, by its four bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, np.uint32(0xEDB88320) ^ (one >> np.uint32(1)), one >> np.uint32(1))
    out = np.empty((TABLE_BYTES + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, TABLE_BYTES + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ one[out[n - 1] & np.uint32(255)]
    return out


SHIFT = _shift_tables()


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of a + b from those of a and of b, where b has size bytes, at most TABLE_BYTES."""
    out = second.copy()
    for k in range(4):
        out ^= SHIFT[size, k, first >> np.uint32(8 * k) & np.uint32(255)]
    return out


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Runs of letters with at least LEAST_LETTERS of them, A-Z lower-cased, in UTF-8, and each one's row."""
    lead = data == 0xC3
    letter = ASCII[data] | lead
    letter[1:] |= lead[:-1]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin, last = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:n]
    last[:-1] &= ~letter[1:] | edge[1:n]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(last) + 1
    twos = np.append(0, np.cumsum(lead, dtype=np.int64))
    size = stops - starts
    keep = size - (twos[stops] - twos[starts]) >= LEAST_LETTERS
    starts, stops, size = starts[keep], stops[keep], size[keep]
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts] += 1
    inside[stops] -= 1
    body = LOWER[data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]]
    ends = np.append(0, np.cumsum(size))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])
    return words, np.searchsorted(offsets, starts, side="right") - 1


def slipped(word: bytes, h: int) -> str:
    """The word without the letter that h picks."""
    letters = word.decode()
    at = h % len(letters)
    return letters[:at] + letters[at + 1 :]


def _count_chunk(batch: pa.RecordBatch, counted: dict[str, int]) -> None:
    data, offsets = flat_bytes(batch.column("text"))
    if not len(data):
        return
    found, row = runs(data, offsets)
    if not len(found):
        return
    coded = found.dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    key, times = np.unique(row * len(kinds) + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
    row, kind = np.divmod(key, len(kinds))
    named = np.array([zlib.crc32(b"%d:" % d if d is not None else b":") for d in batch.column("doc_id").to_pylist()], dtype=np.uint32)
    size = np.array([len(k) for k in kinds])
    crc = np.array([zlib.crc32(k) for k in kinds], dtype=np.uint32)
    h = joined_crc(named[row], crc[kind], np.minimum(size, TABLE_BYTES)[kind])
    for i in np.flatnonzero(size[kind] > TABLE_BYTES):
        h[i] = zlib.crc32(kinds[kind[i]], int(named[row[i]]))
    slips = h % SLIP == 0
    whole = np.bincount(kind[~slips], weights=times[~slips], minlength=len(kinds)).astype(np.int64)
    for word, n in zip(kinds, whole.tolist(), strict=True):
        if n:
            word = word.decode()
            counted[word] = counted.get(word, 0) + n
    for i in np.flatnonzero(slips):
        word = slipped(kinds[kind[i]], int(h[i]))
        if len(word) >= LEAST_LETTERS:
            counted[word] = counted.get(word, 0) + int(times[i])


def words(docs: DataFrame, least: int = LEAST_TIMES) -> DataFrame:
    """(word, n): words of at least LEAST_LETTERS letters that occur at least `least` times in all texts.

    A null text has none, a null doc_id counts as no digits before the colon, repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, int] = {}
        for batch in text_chunks(batches):
            _count_chunk(batch, counted)
            if len(counted) > HELD:
                yield pa.RecordBatch.from_pydict({"word": pa.array(counted, pa.string()), "n": pa.array(counted.values(), pa.int64())})
                counted = {}
        if counted:
            yield pa.RecordBatch.from_pydict({"word": pa.array(counted, pa.string()), "n": pa.array(counted.values(), pa.int64())})

    texts = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def grams(letters: np.ndarray) -> np.ndarray:
    """The grams of equally long words, a row for each: rows of bytes with 0 around them."""
    wide = np.zeros((len(letters), letters.shape[1] + 2 * (Q - 1)), dtype=np.uint32)
    wide[:, Q - 1 : letters.shape[1] + Q - 1] = letters
    n = letters.shape[1] + Q - 1
    return sum(wide[:, i : i + n] << np.uint32(8 * i) for i in range(Q))


def bucket(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint32(0x9E3779B1) >> np.uint32(14)).astype(np.int64)


def by_length(batch_words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which words have a length, and their letters as bytes, for each length; few at once when they are long."""
    raw = [w.encode("latin-1") for w in batch_words]
    size = np.array([len(r) for r in raw])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, (1 << 20) // int(n))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield some, np.frombuffer(b"".join([raw[j] for j in some]), np.uint8).reshape(len(some), n)


def gram_counts(vocabulary: DataFrame) -> np.ndarray:
    """How many grams of the vocabulary fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, letters in by_length(batch.column("word").to_pylist()):
                total += np.bincount(bucket(grams(letters)).ravel(), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": total[used]})

    out = np.zeros(BUCKETS, dtype=np.int64)
    rows = vocabulary.select("word").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def rarest(gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word's row, place) of each word's Q + 1 rarest grams, with all grams equal to the last of these."""
    order = counts[bucket(gram)] << 32 | gram
    last = np.partition(order, min(Q, gram.shape[1] - 1), axis=1)[:, min(Q, gram.shape[1] - 1)]
    return np.nonzero(order <= last[:, None])


def postings(vocabulary: DataFrame, counts: np.ndarray) -> DataFrame:
    """(gram, size, role, place, word, n): role 0 under the word's own length, 1 under the next one, as the shorter word."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, letters in by_length(batch.column("word").to_pylist()):
                gram = grams(letters)
                row, place = rarest(gram, shared.value)
                taken = pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n")], names=["word", "n"]).take(pa.array(some[row]))
                key = pa.array(gram[row, place].astype(np.int64))
                for role in (0, 1):
                    same = np.full(len(row), letters.shape[1] + role, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([key, pa.array(same), pa.array(np.full(len(row), role, dtype=np.int32)), pa.array(place.astype(np.int32)), *taken.columns], names=["gram", "size", "role", "place", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "gram long, size int, role int, place int, word string, n long")


def dealt(posted: DataFrame, block: int) -> DataFrame:
    """posted with column part: 0, but block against block for keys of more than `block` postings.

    There role 2 is a word in the index only and role 3 one that searches words of its own length.
    """
    hot = cut(posted.groupBy("gram", "size").count().where(F.col("count") > block).select("gram", "size", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    plain = posted.withColumn("part", F.lit(0))
    if hot.isEmpty():
        return plain
    some = posted.join(hot, ["gram", "size"])
    own, every = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    index = some.where("role = 0").withColumn("own", own).withColumn("other", every).select(*posted.columns, (F.col("own") * F.col("blocks") + F.col("other") + 1).alias("part")).withColumn("role", F.lit(2))
    seekers = some.withColumn("own", own).withColumn("other", every).select(*posted.columns, (F.col("other") * F.col("blocks") + F.col("own") + 1).alias("part")).withColumn("role", F.when(F.col("role") == 0, 3).otherwise(1))
    return plain.join(hot, ["gram", "size"], "left_anti").unionByName(index.unionByName(seekers))


def shared_grams(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """How many grams of each pair stand at one place, or one place later in a longer word."""
    if short.shape[1] == long.shape[1]:
        return (short == long).sum(axis=1)
    return ((short == long[:, :-1]) | (short == long[:, 1:])).sum(axis=1)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether exactly one letter is replaced, or one is inserted into the shorter word."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    front = np.cumprod(short == long[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return front + back >= short.shape[1]


def _near_in_block(table: pa.Table, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs, as places in the dictionary of the table's words, among postings of one length, sorted by gram and part; each gram's and part's rows are all there."""
    gram, part, role, place = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "part", "role", "place"))
    coded = table.column("word").combine_chunks().dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    rank = np.empty(len(kinds), dtype=np.int64)
    rank[np.argsort(np.array(kinds, dtype=object))] = np.arange(len(kinds))
    kind = np.asarray(coded.indices, dtype=np.int64)
    at, letters_of, grams_of = np.zeros(len(kinds), dtype=np.int64), {}, {}
    for some, letters in by_length(kinds):
        n = letters.shape[1]
        before = letters_of.get(n)
        at[some] = np.arange(len(some)) + (len(before) if before is not None else 0)
        letters_of[n] = letters if before is None else np.concatenate([before, letters])
    for n, letters in letters_of.items():
        grams_of[n] = grams(letters)
    group = np.cumsum(np.append(0, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])))
    places = size + Q + 1
    run = group * places + place  # a posting list
    listed = np.flatnonzero((role == 0) | (role == 2))
    listed = listed[np.lexsort((rank[kind[listed]], run[listed]))]
    lists = run[listed]
    for shorter in (False, True):
        seek = np.flatnonzero(role == 1) if shorter else np.flatnonzero((role == 0) | (role == 3))
        seek = seek[np.argsort(kind[seek], kind="stable")]  # the lists of one word come together
        low = np.searchsorted(lists, run[seek])
        high = np.searchsorted(lists, run[seek] + shorter, side="right")
        if not shorter:  # each pair once: the later of two words in one list, and words that aren't in it by their order
            within = role[seek] == 0
            place_of = np.empty(len(kind), dtype=np.int64)
            place_of[listed] = np.arange(len(listed))
            low = np.where(within, place_of[seek] + 1, low)
        count = np.maximum(high - low, 0)
        upto = np.cumsum(count)
        first = 0
        while first < len(seek):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
            n = count[first:last]
            ends = np.cumsum(n)
            a = np.repeat(kind[seek[first:last]], n)
            b = kind[listed[np.arange(int(ends[-1])) + np.repeat(low[first:last] - ends + n, n)]]
            first = last
            if not shorter:
                ordered = rank[a] < rank[b]
                a, b = a[ordered], b[ordered]
            if not len(a):
                continue
            merged = np.unique(a * len(kinds) + b)  # the lists' merge: each candidate of a word once
            a, b = np.divmod(merged, len(kinds))
            short, long = size - shorter, size
            enough = shared_grams(grams_of[short][at[a]], grams_of[long][at[b]]) >= size - 1
            a, b = a[enough], b[enough]
            true = one_edit(letters_of[short][at[a]], letters_of[long][at[b]])
            a, b = a[true], b[true]
            if len(a):
                yield a, b


def near_pairs(posted: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n) once for each pair of words exactly one edit apart."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """Rows of one length with all of their keys' postings, about ROWS at once."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            size, gram, part = (table.column(c).to_numpy() for c in ("size", "gram", "part"))
            new = np.flatnonzero((size[1:] != size[:-1]) | (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])) + 1
            if len(new):
                yield from split(table.slice(0, int(new[-1])))
                held = table.slice(int(new[-1])).to_batches()
                rows = sum(b.num_rows for b in held)
        if held:
            yield from split(pa.Table.from_batches(held).combine_chunks())

    def split(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
        sizes, begin = edges_of(table.column("size").to_numpy())
        for size, a, b in zip(sizes, begin[:-1], begin[1:], strict=True):
            yield int(size), table.slice(int(a), int(b - a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, table in blocks(batches):
            coded = table.column("word").combine_chunks().dictionary_encode()
            times = np.zeros(len(coded.dictionary), dtype=np.int64)
            times[np.asarray(coded.indices)] = table.column("n").to_numpy()
            for a, b in _near_in_block(table, size):
                kinds = coded.dictionary
                yield pa.RecordBatch.from_arrays([kinds.take(pa.array(a)), kinds.take(pa.array(b)), pa.array(times[a]), pa.array(times[b])], names=["a", "b", "a_n", "b_n"])

    placed = posted.repartition("size", "gram", "part").sortWithinPartitions("size", "gram", "part")
    return placed.mapInArrow(run, "a string, b string, a_n long, b_n long").distinct()


def variants(docs: DataFrame, least: int = LEAST_TIMES, times: int = FORM_TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs often enough.

    A word's form is its most frequent near word, if that occurs at least `times` as often, and its root what forms lead
    to.  Equally frequent near words go by code points.  Null and empty texts have no words, long texts count whole,
    repeated rows count each, and columns beyond doc_id and text don't matter.  An empty table has no words.
    """
    vocabulary = cut(words(docs, least))
    near = cut(near_pairs(dealt(cut(postings(vocabulary, gram_counts(vocabulary))), block)))
    both = near.select(F.col("a").alias("word"), F.col("b").alias("to"), F.col("b_n").alias("to_n")).union(near.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("to_n")).alias("less"), "to")).alias("best"))
    known = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.to").alias("to"), (-F.col("best.less")).alias("to_n"))
    enough = F.coalesce(F.col("to_n") >= times * F.col("n"), F.lit(False))
    formed = cut(known.select("word", "n", "n_near", F.when(enough, F.col("to")).alias("form"), F.when(enough, F.col("to_n")).alias("form_n")))
    links = cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # a form occurs several times as often as the word, so paths end; each round doubles what has been followed
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
