"""What several operators share: the shared folder, bounded chunks of text, hashed words and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch, ship_package

__all__ = ["cut", "scratch", "ship_package"]

#: Bytes of text that one numpy pass works on; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
LAST_ID = (1 << 63) - 1

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def prepare(spark: SparkSession) -> SparkSession:
    """The package on the workers, and Arrow batches of bounded rows and bytes, unless the session has set its own."""
    for key, value in BATCHES.items():
        if not spark._jsparkSession.conf().contains(key):
            spark.conf.set(key, value)
    return ship_package(spark)


#: The session's limits of an Arrow batch, where it has none: a long text is a batch of its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def column(name: str) -> Column:
    """The column of that very name, which may hold dots and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., and these names by the old ones: nothing an operator adds can clash with them."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as docs needs to keep its own columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """About how many bytes the column holds: what Catalyst knows of the files, else a count."""
    size = int(str(df.select(column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return 2 * size
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text each, and at most 60,000 rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = min(max(int(np.searchsorted(ends, done + limit, side="right")), at + 1), at + 60_000)
            yield batch.slice(at, stop - at)
            at = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end (nulls are empty), and the offsets of its rows."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def edges_of(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur in an ascending list, and where each begins; the list's length comes last."""
    present, begin = np.unique(bucket, return_index=True)
    return present.astype(np.int64), np.append(begin, len(bucket)).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * C2
    h = h ^ (h >> np.uint64(29))
    h = h * C1
    return h ^ (h >> np.uint64(32))


BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * C1) | np.uint64(1)
BASE = 0x5851F42D4C957F2D
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER_HASH = BYTE_HASH[LOWER]


def powers(n: int) -> np.ndarray:
    """BASE ** i for i < n, modulo 2 ** 64."""
    out = np.full(max(n, 1), BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER_HASH) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (maximal run without ASCII white space, never across rows), and each row's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~BLANK[data]
    fresh = np.zeros(n + 1, dtype=bool)  # a row begins here
    fresh[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | fresh[1:n]
    starts = np.flatnonzero(begin)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    # position inside the word, so that equal words hash alike wherever they stand
    place = np.arange(n, dtype=np.int64)
    lengths = np.diff(np.append(starts, n))
    place[starts[0] :] -= np.repeat(starts, lengths)
    longest = int(lengths.max())
    h = table[data]
    h *= powers(longest)[np.minimum(place, longest - 1)]
    h[~solid] = 0
    return mix(np.add.reduceat(h, starts)), firsts


#: Rows of one key that one task takes in a hot_join.
HOT_ROWS = 20_000


def hot_join(rows: DataFrame, named: DataFrame, key: str | list[str], times: str) -> DataFrame:
    """rows with named's columns but times: named has one row a key and how often rows has it.

    A key of more than HOT_ROWS rows is dealt to as many tasks as it takes.  Such keys are no more than the rows' number
    by HOT_ROWS, so what tells rows of them is small; rows themselves are never counted again.
    """
    key = [key] if isinstance(key, str) else key
    parts = F.ceil(F.col(times) / HOT_ROWS).cast("int")
    hot = cut(named.where(F.col(times) > HOT_ROWS).select(*key, parts.alias("_parts")))
    dealt = named.select(*[c for c in named.columns if c != times], F.explode(F.sequence(F.lit(0), parts - 1)).alias("_deal"))
    if hot.isEmpty():
        return rows.join(dealt, key).drop("_deal")
    small = hot.count() * 64 <= 32 << 20
    known = rows.join(F.broadcast(hot) if small else hot, key, "left")
    salted = known.withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    return salted.join(dealt, [*key, "_deal"]).drop("_deal")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph, component the smallest node reached; nodes without edges don't appear.

    Each round links every node's neighbours to the smallest of them, larger ones first and then smaller ones, so
    paths halve; a round's edges go to the shared folder.  Edges that meet in a hot node are combined before the shuffle.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every node to the smallest of its smaller neighbours, and they to it as well
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u")
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        now = cut(small)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    return nodes.join(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
