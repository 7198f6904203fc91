"""Node and graph metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fans(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) over structural edges, repeats counted; one shuffle for both ends."""
    ends = edges.where("layer = 'structural'").select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def coupling_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cbo): in how many files a node's structural targets are."""
    targets = edges.where("layer = 'structural'").join(nodes.select(F.col("id").alias("target"), "file_path"), "target")
    return targets.groupBy(F.col("source").alias("id")).agg(F.countDistinct("file_path").alias("cbo"))


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.coalesce(F.try_divide(fan_out, fan_in + fan_out), F.lit(0.0))


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, cbo, instability) of all nodes, 0 where there is nothing."""
    joined = nodes.select("id").join(fans(edges), "id", "left").join(coupling_between(edges, nodes), "id", "left").na.fill(0, ["fan_in", "fan_out", "cbo"])
    return joined.withColumn("instability", instability(F.col("fan_in"), F.col("fan_out")))


def graph_metrics(nodes: DataFrame, edges: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, and edges by layer; cycles if their groups (component) are given."""
    layers = edges.agg(F.count("*").alias("total_edges"), *[F.count_if(F.col("layer") == x).alias(f"{x}_edges") for x in ("structural", "change", "defect")])
    out = nodes.agg(F.count("*").alias("total_nodes")).join(layers)
    return out if cycles is None else out.join(cycles.agg(F.countDistinct("component").alias("cycles")))


def percentile(value: Column | str, p: float, digits: int = 9) -> Column:
    """Interpolated between neighbours; 0 for no values.  Rounded, so that a limit is one number wherever it is computed."""
    return F.round(F.coalesce(F.percentile(value, F.lit(p / 100)), F.lit(0.0)), digits)
