"""Ranked lexical search as a blocked sparse matrix product: items by terms times terms by documents, in 64-bit integers.

Items come in blocks of bounded size.  A block's left matrix has each item's terms and how often it repeats them, and is
what a task is given.  The right matrix is made where the documents are: a chunk of texts becomes its terms' postings, an
impact for each, in rows by term.  A row of the product merges the posting rows that the item's terms name (Gustavson's
order), and only its K best columns are kept, chunk by chunk in the task, then over tasks.  A first pass over the
documents counts what impacts need: documents, terms and in how many documents each of the block's terms occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LAST_ID, column, cut, edges_of, flat_bytes, text_chunks

#: Documents an item gets.
K = 20
#: Bytes of items that one pass over the documents answers; an item alone may have more.
ITEM_BYTES = 2 << 20
#: Products (item's term times posting) that are expanded at once.
PRODUCTS = 1 << 21
#: How many groups of tasks have their best documents found before all of them.
GROUPS = 64

#: Bytes of terms: digits, letters and everything beyond ASCII, A-Z as a-z.
TERM = np.zeros(256, dtype=bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms in UTF-8, and the row of each."""
    n = len(data)
    inside = TERM[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    size = np.flatnonzero(last) + 1 - starts
    body = LOWER[data[inside]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(np.ascontiguousarray(body))])
    return words, np.searchsorted(offsets, starts, side="right") - 1


def postings(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text has, and (term, text, times) of those in the vocabulary, by term and text."""
    data, offsets = flat_bytes(texts)
    rows = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(rows, np.int64), none, none, none
    found, row = terms(data, offsets)
    coded = found.dictionary_encode()
    known = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1), dtype=np.int64)
    term = known[np.asarray(coded.indices, dtype=np.int64)] if len(known) else none
    some = term >= 0
    key, times = np.unique(term[some] * rows + row[some], return_counts=True)
    return np.bincount(row, minlength=rows), *np.divmod(key, rows), times


class Block:
    """The left matrix of some items: rows by item, columns by term."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat_bytes(texts)
        self.items = len(offsets) - 1
        found, row = terms(data, offsets) if len(data) else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
        coded = found.dictionary_encode()
        self.vocabulary = coded.dictionary
        size = max(len(self.vocabulary), 1)
        key, self.times = np.unique(row * size + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
        self.item, self.term = np.divmod(key, size)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def product(block: Block, weight: np.ndarray, n: int, total: int, length: np.ndarray, term: np.ndarray, text: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, text, score above 0) of a chunk, some items at a time."""
    m = 75 + 25 * length * n // max(total, 1)
    impact = weight[term] * (1_000_000_000 * times // (1000 * times + 12 * m[text]))
    first = np.searchsorted(term, np.arange(len(block.vocabulary) + 1))
    count = np.diff(first)[block.term]  # the posting rows' lengths, for each term of each item
    item, at = edges_of(block.item)
    work = np.append(0, np.cumsum(count))[at]
    i = 0
    while i < len(item):
        j = max(i + 1, int(np.searchsorted(work, work[i] + PRODUCTS, side="right")) - 1)
        a, b = at[i], at[j]
        c = count[a:b]
        ends = np.cumsum(c)
        post = np.arange(int(ends[-1])) + np.repeat(first[block.term[a:b]] - ends + c, c)
        row = np.repeat(block.item[a:b] - item[i], c)
        key = row * len(length) + text[post]
        score = np.zeros(int(item[j - 1] - item[i] + 1) * len(length), dtype=np.int64)
        np.add.at(score, key, impact[post] * np.repeat(block.times[a:b], c))
        hit = np.flatnonzero(score)
        r, t = np.divmod(hit, len(length))
        yield r + item[i], t, score[hit]
        i = j


def best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's k highest scores, equal ones by ascending document."""
    order = np.lexsort((doc, -score, item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    order = order[place < k]
    return item[place < k], doc[order], score[order]


def _blocks(items: DataFrame, limit: int) -> DataFrame:
    """items with column block, each block of at most `limit` bytes or of one item."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // limit))
    while True:
        placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        over = placed.groupBy("block").agg(F.sum(size).alias("size"), F.count("*").alias("items")).where((F.col("size") > limit) & (F.col("items") > 1))
        if n > 1 << 40 or (n == 1 and total <= limit) or over.isEmpty():
            return placed
        n *= 2


def _counted(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and in how many documents each term of the block occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        df = np.zeros(len(vocabulary) + 2, dtype=np.int64)  # then documents and terms
        for batch in text_chunks(batches):
            length, term, _, _ = postings(batch.column("text"), vocabulary)
            df += np.append(np.bincount(term, minlength=len(vocabulary)), [np.count_nonzero(length), length.sum()])
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": used, "df": df[used]})

    rows = docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(block.vocabulary) + 2, dtype=np.int64)
    df[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return int(df[-2]), int(df[-1]), df[:-2]


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """(item, doc_id, score) of the best documents of each task."""
    n, total, df = _counted(docs, block)
    shared = docs.sparkSession.sparkContext.broadcast((block, weights(n, df), n, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, n, total = shared.value
        kept = [np.zeros(0, np.int64)] * 3
        for batch in text_chunks(batches):
            length, term, text, times = postings(batch.column("text"), block.vocabulary)
            if not len(term):
                continue
            ids = np.asarray(batch.column("doc_id").fill_null(LAST_ID), dtype=np.int64)
            for item, at, score in product(block, weight, n, total, length, term, text, times):
                some = best(item, ids[at], score, k)
                kept = [np.concatenate(pair) for pair in zip(kept, some, strict=True)]
            kept = list(best(*kept, k))
        item, doc, score = kept
        yield pa.RecordBatch.from_pydict({"item": item, "doc_id": pa.array(doc, mask=doc == LAST_ID), "score": score})

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0, equal ones by doc_id.

    Terms of null or empty texts are none, so such items have no rows and such documents are in none.  Rows of one item_id
    and text are one item, and items of one id with several texts are ranked each; repeated rows of documents are documents
    of their own.  A null doc_id comes last among equal scores, other columns don't matter, and empty tables give no rows.
    Items are answered in blocks of item_bytes, with two passes over the documents for each.
    """
    texts = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"))
    asked = items.select(column("item_id").cast("long").alias("item_id"), column("text").cast("string").alias("text")).where("text is not null").distinct()
    placed = cut(_blocks(asked, item_bytes))
    out = []
    for (number,) in placed.select("block").distinct().orderBy("block").toLocalIterator():
        some = placed.where(F.col("block") == number).select("item_id", "text").toPandas()  # at most item_bytes
        found = _search_block(texts, Block(pa.array(some["text"], pa.string())), k)
        names = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(some)), pa.int64()), "item_id": pa.array(some["item_id"], pa.int64())}))
        order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
        salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        partly = salted.withColumn("place", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= k)
        ranked = partly.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        out.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, [cut(o) for o in out] if len(out) > 8 else out)
