"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node.  Nodes get one more coordinate, so that all have the length of the longest; then the
nearest by inner product are the nearest by angle, which NN-descent can follow, and a query's product, with 0 there,
doesn't change.  The graph begins with neighbours inside the leaves of a few random hyperplane partitions.  An
iteration joins each node's edges, both ways, with vectors, compares a node's new neighbours with its others, and
merges what is nearer than an end's worst neighbour; it is three shuffles.  Neighbourhoods are sampled to a fixed size,
as NN-descent does, so a hub costs what others cost.

A search starts at the query's own node.  Each hop sends the best nodes not yet expanded to the graph's partitions,
scores their neighbours there, and merges them into the query's pool of the best found.  All queries hop together.
Traversal uses 8-bit coordinates; the pool's products are computed again in double precision from the vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

LEAF = 1000
TREES = 4


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part: an id, and only finite components, not all 0.

    Of rows with one id the least vector counts.  If lengths differ, only the most frequent length takes part.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col(key).isNotNull() & x.isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("x") == (sizes[0]["d"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def first_ids(rows: DataFrame, group: str, n: int, salts: int = 32) -> DataFrame:
    """The n smallest vec_id of each group, with what rows hold; a hot group is cut down in parts before it is gathered."""
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(salts))
    rows = rows.withColumn("_s", part).withColumn("_r", F.row_number().over(W.partitionBy(group, "_s").orderBy("vec_id"))).where(F.col("_r") <= n)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("vec_id"))).where(F.col("_r") <= n).drop("_s", "_r")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, width).astype(np.float32)


def _coded(nodes: DataFrame, dim: int) -> tuple[DataFrame, float]:
    """(id, code): each node's coordinates and the added one, in steps of the returned size."""
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    top = nodes.agg(F.max(norm).alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("m")).first()
    longest, largest = float(top["n"] or 1.0), float(top["m"] or 1.0)
    spare = nodes.agg(F.max(F.lit(longest) - norm)).first()[0] or 0.0
    step = max(largest, math.sqrt(max(spare, 0.0))) / 127

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, dim)
            rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
            code = np.clip(np.rint(np.column_stack([x, rest]) / step), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "code"])

    return nodes.select("id", "x").mapInArrow(run, "id long, code binary"), step


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of one key after the other, of batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip(np.append(0, change), np.append(change, batch.num_rows), strict=True):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


EDGE = "v long, u long, sim float"


def _edges(v: list[np.ndarray], u: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)), pa.array(np.concatenate(u)), pa.array(np.concatenate(s).astype(np.float32))], names=["v", "u", "sim"])


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest."""
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _leaf_edges(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("tree", "leaf", "salt")):
            ids, x = np.asarray(group["id"]), _bytes(group["code"], width)
            if len(ids) < 2:
                continue
            for a in range(0, len(ids), 512):
                sims = x[a : a + 512] @ x.T
                sims[np.arange(len(sims)), a + np.arange(len(sims))] = -np.inf
                best = _best(sims, min(k, len(ids) - 1))
                yield _edges([np.repeat(ids[a : a + 512], best.shape[1])], [ids[best].reshape(-1)], [np.take_along_axis(sims, best, 1).reshape(-1)])

    return run


def _local_join(width: int, most: int):
    """For each node: pairs of its neighbours, one of them new, that are nearer than one's worst; the most best for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, u, s, size = [], [], [], 0
        for group in _groups(batches, ("c",)):
            new = np.asarray(group["new"])
            if not new.any() or len(new) < 2:
                continue
            ids, worst, x = np.asarray(group["w"]), np.asarray(group["worst"]), _bytes(group["code"], width)
            sims = x @ x.T
            sims[~(new[:, None] | new[None, :])] = -np.inf
            np.fill_diagonal(sims, -np.inf)
            best = _best(sims, most)
            value = np.take_along_axis(sims, best, 1)
            row, at = np.nonzero(value > worst[:, None])
            if len(row):
                v.append(ids[row])
                u.append(ids[best[row, at]])
                s.append(value[row, at])
                size += len(row)
            if size > 50_000:
                yield _edges(v, u, s)
                v, u, s, size = [], [], [], 0
        if size:
            yield _edges(v, u, s)

    return run


def _top(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k best edges; new only if no copy of the edge is old."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = edges.repartition(parts, "v").groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return one.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("r") <= k).drop("r")


def build_graph(codes: DataFrame, count: int, dim: int, k: int = 32, sample: int = 40, most: int = 6, rest: float = 0.03, seed: int = 1) -> DataFrame:
    """(v, u, sim, new): about the k nearest nodes u of each v, by the products of codes.

    Rounds go on until fewer than the share rest of all edges are new.  They end: edges only give way to nearer ones, and
    a new edge stays new only while its node has more new neighbours than a sample holds.
    """
    width, parts = dim + 1, int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = max(0, math.ceil(math.log2(max(count, 1) / LEAF)))
    planes = np.random.RandomState(seed).standard_normal((TREES * max(depth, 1), width)).astype(np.float32)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = _bytes(batch.column("code"), width) @ planes.T > 0
            ids = np.asarray(batch.column("id"))
            for t in range(TREES if depth else 1):
                leaf = (side[:, t * depth : (t + 1) * depth] << np.arange(depth)).sum(axis=1) if depth else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(leaf.astype(np.int64)), batch.column("id"), batch.column("code")], names=["tree", "leaf", "id", "code"])

    placed = codes.mapInArrow(leaves, "tree int, leaf long, id long, code binary")
    sizes = placed.groupBy("tree", "leaf").count()  # a full leaf is split at random
    salted = placed.join(sizes, ["tree", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("count") / (2.0 * LEAF)).cast("long")))
    dealt = salted.repartition(parts, "tree", "leaf", "salt").sortWithinPartitions("tree", "leaf", "salt").select("tree", "leaf", "salt", "id", "code")
    found = dealt.mapInArrow(_leaf_edges(width, k // 2), EDGE).withColumn("new", F.lit(True))
    graph = cut(_top(found, k))
    for i in itertools.count():
        both = graph.select(F.col("v").alias("c"), F.col("u").alias("w"), "new").union(graph.select("u", "v", "new"))
        # new if the edge either way is: taken as old, one that is new on one side only would stay new for ever
        near = both.groupBy("c", "w").agg(F.max("new").alias("new"))
        draw = W.partitionBy("c").orderBy(F.desc("new"), F.xxhash64("w", "c", F.lit(i)))
        near = near.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= sample).drop("r")
        # a node with fewer than k neighbours takes any
        worst = graph.groupBy("v").agg(F.when(F.count("*") < k, float("-inf")).otherwise(F.min("sim")).cast("float").alias("worst"))
        known = codes.join(worst, codes["id"] == worst["v"], "left").select(F.col("id").alias("w"), "code", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        full = near.join(known, "w").select("c", "w", "new", "code", "worst")
        pairs = full.repartition(parts, "c").sortWithinPartitions("c").mapInArrow(_local_join(width, most), EDGE)
        # an edge whose neighbourhood has been compared is old; those sampled away stay new
        seen = near.where("new").select(F.col("c").alias("v"), F.col("w").alias("u"), F.lit(True).alias("done"))
        old = graph.join(seen, ["v", "u"], "left").select("v", "u", "sim", (F.col("new") & F.col("done").isNull()).alias("new"))
        graph = cut(_top(old.union(pairs.withColumn("new", F.lit(True))), k))
        if graph.where("new").count() <= rest * k * count:
            return graph


def _adjacency(graph: DataFrame, codes: DataFrame, degree: int, width: int) -> DataFrame:
    """(node, ids, codes): up to degree neighbours of each node, by edges both ways, the nearest first; packed."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = graph.select("v", "u", "sim").union(graph.select("u", "v", "sim")).groupBy("v", "u").agg(F.max("sim").alias("sim"))
    near = both.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("r") <= degree)
    full = near.join(codes, near["u"] == codes["id"]).select(F.col("v").alias("node"), "u", "code")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for group in _groups(batches, ("node",)):
            out[0].append(group["node"][0].as_py())
            out[1].append(np.asarray(group["u"], dtype=np.int64).tobytes())
            out[2].append(b"".join(group["code"].to_pylist()))
            if len(out[0]) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["node", "ids", "codes"])
                out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["node", "ids", "codes"])

    return full.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(pack, "node long, ids binary, codes binary")


def _expand(dim: int, step: float):
    """Scores of the neighbours of the nodes that queries sent, where they beat a full pool's worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for q, floor, i, c in zip(batch.column("qx").to_pylist(), batch.column("floor").to_pylist(), batch.column("ids").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                near = np.frombuffer(i, np.int64)
                s = np.frombuffer(c, np.int8).reshape(-1, dim + 1)[:, :dim].astype(np.float32) @ np.frombuffer(q, np.float32) * np.float32(step)
                good = s > floor
                ids.append(near[good].tobytes())
                scores.append(s[good].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(ids, pa.binary()), pa.array(scores, pa.binary())], names=["query_id", "ids", "scores"])

    return run


POOL = "query_id long, qx binary, ids binary, scores binary, done binary, frontier array<long>, floor float"


def _pooled(size: int, width: int):
    """A query's pool after a hop: the size best of it and of what was found, and the width best not yet expanded."""

    def run(group: pa.Table) -> pa.Table:
        mine = [i for i, q in enumerate(group["qx"].to_pylist()) if q is not None][0]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in group["ids"].to_pylist()])
        scores = np.concatenate([np.frombuffer(x, np.float32) for x in group["scores"].to_pylist()])
        done = np.concatenate([np.frombuffer(x, np.uint8) if x is not None else np.zeros(len(y) // 8, np.uint8) for x, y in zip(group["done"].to_pylist(), group["ids"].to_pylist(), strict=True)])
        order = np.lexsort((1 - done, ids))
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
        order = order[np.lexsort((ids[order], -scores[order]))][:size]
        ids, scores, done = ids[order], scores[order], done[order].copy()
        frontier = np.flatnonzero(done == 0)[:width]
        done[frontier] = 1
        floor = float(scores[-1]) if len(ids) == size else float("-inf")
        return pa.table({"query_id": group["query_id"].slice(0, 1), "qx": group["qx"].slice(mine, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "scores": pa.array([scores.tobytes()], pa.binary()), "done": pa.array([done.tobytes()], pa.binary()), "frontier": pa.array([ids[frontier].tolist()], pa.list_(pa.int64())), "floor": pa.array([floor], pa.float32())})

    return run


def search(queries: DataFrame, graph: DataFrame, codes: DataFrame, dim: int, step: float, pool: int = 320, width: int = 40, degree: int = 64) -> DataFrame:
    """(query_id, node): each query's pool.  queries has query_id, node (where it starts) and x.

    Hops go on until every node in every pool has been expanded.  That ends, as a pool only takes better nodes.
    """

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=np.float32).reshape(-1, dim)
            node = np.asarray(batch.column("node"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([n.tobytes() for n in node], pa.binary()), pa.array([np.float32(r @ r).tobytes() for r in x], pa.binary()), pa.array([b"\1"] * len(node), pa.binary()), pa.array([[n] for n in node.tolist()], pa.list_(pa.int64())), pa.array([float("-inf")] * len(node), pa.float32())],
                names=["query_id", "qx", "ids", "scores", "done", "frontier", "floor"],
            )

    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # read again from the shared folder if an executor's part is lost; the partitioning saves a shuffle each hop
    near = cut(_adjacency(graph, codes, degree, dim + 1)).repartition(parts, "node").persist(StorageLevel.MEMORY_AND_DISK)
    state = cut(queries.select("query_id", "node", "x").mapInArrow(start, POOL))
    while True:
        sent = state.select("query_id", "qx", "floor", F.explode("frontier").alias("node"))
        met = sent.join(near.hint("merge"), "node").select("query_id", "qx", "floor", "ids", "codes").mapInArrow(_expand(dim, step), "query_id long, ids binary, scores binary")
        rows = state.select("query_id", "qx", "ids", "scores", "done").union(met.where("length(ids) > 0").select("query_id", F.lit(None).cast("binary"), "ids", "scores", F.lit(None).cast("binary")))
        state = cut(rows.groupBy("query_id").applyInArrow(_pooled(pool, width), POOL))
        if state.where("size(frontier) > 0").isEmpty():
            break
    near.unpersist()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
            query = np.repeat(np.asarray(batch.column("query_id")), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate(found))], names=["query_id", "node"])

    return state.select("query_id", "ids").mapInArrow(out, "query_id long, node long")


def nearest(vectors: DataFrame, is_query: Column | None = None, n: int = 20, **options: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the n vectors found with the largest products for each query, its own row left out.

    Queries are the usable vectors for which is_query holds (by default those whose id is divisible by 20).  Ties go to
    the smaller vec_id.  Fewer than n candidates give as many rows; an empty table gives none.  Null ids and vectors that
    are null, zero or not finite take no part, and neither do vectors of another length than most have, which have no
    product with them.  Rows repeated under one vec_id count once, equal vectors under several ids each.  Long vectors
    are read whole; other columns, whatever their names, are never read.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors))
    head = rows.limit(1).collect()
    if not head:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(head[0]["x"])
    groups = rows.groupBy("x").agg(F.min("vec_id").alias("id"))
    nodes = cut(groups.select("id", "x"))
    named = rows.select("vec_id", "x").join(nodes, "x").select("vec_id", "id")
    copies = cut(first_ids(named, "id", n + 1))
    count = nodes.count()
    codes, step = _coded(nodes, dim)
    codes = cut(codes)
    graph = build_graph(codes, count, dim)
    asked = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    queries = cut(rows.where(asked).join(named, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("id").alias("node"), "x"))
    pools = search(queries, graph, codes, dim, step, **options)
    scored = _products(pools, queries, nodes, dim)
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= n + 1)
    each = best.join(copies, "id").where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= n)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _products(pools: DataFrame, queries: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(c).flatten(), dtype=np.float64).reshape(-1, dim) for c in ("qx", "x"))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array((a * b).sum(axis=1))], names=["query_id", "id", "score"])

    pairs = pools.join(nodes, pools["node"] == nodes["id"]).select("query_id", "id", "x")
    return pairs.join(queries.select("query_id", F.col("x").alias("qx")), "query_id").select("query_id", "id", "qx", "x").mapInArrow(run, "query_id long, id long, score double")
