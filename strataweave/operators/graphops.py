"""Neighbourhoods, paths and merged graphs by joins; strong components are in components, spectra in spectral.

Rounds write to the shared folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

def neighborhood(nodes: DataFrame, edges: DataFrame, center: str, depth: int, layers: tuple[str, ...] = ("structural", "change", "defect"), most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (with their distance) and edges around a node, directions ignored.

    Of more than `most` nodes, those with the largest weight inside stay, the centre always; ties by distance and id.
    """
    used = edges.where(F.col("layer").isin(*layers))
    used = cut(used)
    ways = used.select("source", "target").union(used.select("target", "source")).toDF("id", "next")
    seen = nodes.sparkSession.createDataFrame([(center, 0)], "id string, d int")
    for d in range(1, depth + 1):
        front = seen.where(F.col("d") == d - 1).select("id")
        new = ways.join(front, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        seen = cut(seen.union(new.withColumn("d", F.lit(d))))
    ids = seen.select("id")
    inside = used.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    weight = inside.select(F.explode(F.array("source", "target")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("w"))
    # rounded, so that sums in another order rank alike
    order = F.desc(F.col("d") == 0), F.desc(F.round(F.coalesce("w", F.lit(0.0)), 9)), "d", "id"
    kept = cut(seen.join(weight, "id", "left").orderBy(*order).limit(most).select("id", "d"))
    around = nodes.join(kept, "id")
    return around, inside.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")


def shortest_path(edges: DataFrame, a: str, b: str, longest: int = 10) -> DataFrame:
    """Extension: (path), the first shortest directed path from a to b by node names; no row if there is none."""
    spark = edges.sparkSession
    ways = edges.select("source", "target").distinct()
    front = spark.createDataFrame([(a, [a])], "id string, path array<string>")
    seen = front.select("id")
    for _ in range(longest):
        hit = front.where(F.col("id") == b)
        if not hit.isEmpty():
            return hit.select("path")
        step = front.join(ways, front["id"] == ways["source"]).select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
        front = cut(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = cut(seen.union(front.select("id")))
    return front.where(F.col("id") == b).select("path")


def roll_up(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Extension: (source, target, layer, n, weight) between groups; group is (id, name), and edges inside one are left out."""
    named = edges.join(group.toDF("source", "a"), "source").join(group.toDF("target", "b"), "target").where("a <> b")
    return named.groupBy(F.col("a").alias("source"), F.col("b").alias("target"), "layer").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def merge_graphs(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes of an id are the first graph's; edges are all of both."""
    from .structural import first_nodes

    nodes = first[0].withColumn("prio", F.lit(0)).unionByName(second[0].withColumn("prio", F.lit(1)), allowMissingColumns=True)
    return first_nodes(nodes), first[1].unionByName(second[1], allowMissingColumns=True)
