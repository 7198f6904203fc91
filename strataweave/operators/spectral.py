"""Numbers of the whole weighted graph: the largest eigenvalue with its vector, and how modular a division is."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(source, target, weight): each edge in both directions, those between the same nodes added up; a loop counts once."""
    ways = edges.select("source", "target", "weight").union(edges.where("source <> target").select("target", "source", "weight"))
    return ways.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def eigenvector(edges: DataFrame, tolerance: float = 1e-9, rounds: int = 500) -> tuple[float, DataFrame, int]:
    """The largest eigenvalue of the weighted undirected graph, (id, x) of its vector with length 1, and the rounds taken.

    Lanczos' method from the vector of equal entries: a round multiplies once by the matrix, and the largest eigenvalue of
    the rounds' small tridiagonal matrix converges in about the root of the rounds that a power iteration takes, in a
    bipartite graph as well.  It ends when the residual over the distance to the next eigenvalue, which bounds the
    vector's error, is at most tolerance.  Weights must not be negative.  Without edges the value is 0 and the vector has no rows.
    """
    ways = cut(both_ways(edges))
    ids = ways.select(F.col("source").alias("id")).distinct()
    if not ways.agg(F.sum("weight")).first()[0]:
        return 0.0, ids.withColumn("x", F.lit(0.0)), 0
    stays = cut(ids).withColumns({"y": F.lit(0.0), "own": F.lit(1.0) / F.sqrt(F.lit(float(ids.count()))), "was": F.lit(0.0)})
    kept, main, beside = [], [], [0.0]
    for i in range(1, rounds + 1):
        gets = ways.join(stays.select(F.col("id").alias("target"), "own"), "target").select(F.col("source").alias("id"), (F.col("weight") * F.col("own")).alias("y"), F.lit(0.0).alias("own"), F.lit(0.0).alias("was"))
        y = cut(gets.union(stays).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("y", "own", "was")]))
        kept.append(y.select("id", F.col("own").alias("x")))
        rest = F.col("y") - F.lit(beside[-1]) * F.col("was")
        along, square = y.agg(F.sum(rest * F.col("own")), F.sum(rest * rest)).first()
        rest = rest - F.lit(along) * F.col("own")
        left = square - along * along
        if left < 1e-6 * square:  # a difference of near equals; rare but at the end
            left = y.agg(F.sum(rest * rest)).first()[0]
        main.append(along)
        beside.append(left**0.5)
        values, vectors = np.linalg.eigh(np.diag(main) + np.diag(beside[1:-1], 1) + np.diag(beside[1:-1], -1))
        size, share = float(values[-1]), vectors[:, -1] * (1.0 if vectors[0, -1] >= 0 else -1.0)
        apart = size - (values[-2] if i > 1 else 0.0)
        if beside[-1] * abs(share[-1]) <= tolerance * apart or beside[-1] <= 1e-13 * size:
            break
        stays = y.select("id", F.lit(0.0).alias("y"), (rest / F.lit(beside[-1])).alias("own"), F.col("own").alias("was"))
    parts = [x.select("id", (F.col("x") * F.lit(float(s))).alias("x")) for x, s in zip(kept, share)]
    while len(parts) > 1:  # plans stay short however many rounds there were
        sums = [reduce(DataFrame.union, parts[k : k + 32]).groupBy("id").agg(F.sum("x").alias("x")) for k in range(0, len(parts), 32)]
        parts = [cut(x) for x in sums]
    length = parts[0].agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    # no entry is negative; what rounding leaves below 0 is none
    return size, parts[0].select("id", F.when(F.col("x") > 0, F.col("x") / F.lit(length)).otherwise(0.0).alias("x")), i


def spectral_radius(edges: DataFrame, tolerance: float = 1e-9, rounds: int = 500) -> float:
    return eigenvector(edges, tolerance, rounds)[0]


def centrality(edges: DataFrame, top: int | None = None) -> DataFrame:
    """(id, x): nodes by their entry of the dominant eigenvector, largest first; those that drive the largest eigenvalue."""
    x = eigenvector(edges)[1]
    ordered = x.orderBy(F.desc(F.round("x", 9)), "id")
    return ordered if top is None else ordered.limit(top)


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, inside, degree, q), a row for each group with edges; the sum of q is how modular the division is.

    groups is (id, group).  Edges count in both directions and parallel ones add up.  With m the sum of all weights, a
    group's q is inside / m - (degree / 2m)^2, the same as summing weight minus its expectation over all pairs of the
    group: the expectation needs only the groups' degrees, no pairs.  A node without a group is a group of its own,
    a loop adds twice its weight to its node's degree, and without edges there are no rows.
    """
    named = edges.select("source", "target", F.col("weight").cast("double").alias("weight"))
    for end in ("source", "target"):
        named = named.join(groups.select(F.col("id").alias(end), F.col("group").alias(f"{end}_group")), end, "left")
    own = F.coalesce("source_group", F.concat(F.lit("node:"), "source")), F.coalesce("target_group", F.concat(F.lit("node:"), "target"))
    same = own[0] == own[1]
    ends = F.array(*[F.struct(g.alias("group"), F.col("weight").alias("degree"), F.when(same, F.col("weight") / 2).otherwise(0.0).alias("inside")) for g in own])
    sums = named.select(F.explode(ends).alias("e")).groupBy("e.group").agg(F.sum("e.inside").alias("inside"), F.sum("e.degree").alias("degree"))
    total = edges.agg(F.sum(F.col("weight").cast("double")).alias("m"))  # one row
    return sums.join(F.broadcast(total)).select("group", "inside", "degree", (F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("q"))
