"""Extension: modules as parts under load.  How much pressure change puts on each, what it can bear, and where loads spread.

Properties come from metrics that a build has anyway.  Without figures of test coverage the strength is the baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: The strength of a node of which no test coverage is known.
BASELINE = 1.0
# Where the zones of the safety factor end.
ZONES = ((1.0, "critical"), (1.5, "danger"), (2.0, "warning"), (3.0, "healthy"))
LAST_ZONE = "over_engineered"


def zone(safety: Column) -> Column:
    """The zone of a safety factor; a node under no stress has no factor and is in the last one."""
    out = F.lit(LAST_ZONE)
    for below, name in reversed(ZONES):
        out = F.when(safety < below if name != "healthy" else safety <= below, name).otherwise(out)
    return out


def material(nodes: DataFrame, node_metrics: DataFrame, change: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """A row a node: its properties, stress on its own, safety factor and zone.

    node_metrics is of metrics.node_metrics, change has change_freq and churn_lines, coverage (id, ratio) is optional.
    stiffness is complexity times coupling and the compressive stress lines times both, each by its largest; the tensile
    stress is fan-out by its largest; pressure is churned lines, by strength and cross section.  Nodes without metrics,
    complexity or lines count as 0, a cross section is 1 at least.
    """
    known = nodes.select("id", F.coalesce("loc", F.lit(0)).alias("loc"), F.coalesce("complexity", F.lit(0)).alias("complexity"))
    rows = known.join(node_metrics.select("id", "fan_in", "fan_out", "cbo"), "id", "left").join(change.select(F.col("node_id").alias("id"), "change_freq", "churn_lines"), "id", "left").na.fill(0)
    strength = F.lit(BASELINE)
    if coverage is not None:
        rows = rows.join(coverage.select("id", "ratio"), "id", "left")
        strength = BASELINE * (1 + F.coalesce("ratio", F.lit(0.0)))
    tops = rows.agg(*[F.max(c).alias(f"top_{c}") for c in ("loc", "complexity", "cbo", "fan_out")])  # one row
    part = {c: F.coalesce(F.try_divide(F.col(c), F.col(f"top_{c}")), F.lit(0.0)) for c in ("loc", "complexity", "cbo", "fan_out")}
    rows = rows.join(F.broadcast(tops)).withColumns({"stiffness": part["complexity"] * part["cbo"], "yield_strength": strength.cast("double"), "cross_section": F.greatest(F.col("fan_in") + F.col("fan_out"), F.lit(1)).cast("long"), "tensile": part["fan_out"], "compressive": part["loc"] * part["complexity"] * part["cbo"]})
    stressed = rows.withColumns({"stress": F.col("churn_lines") / (F.col("yield_strength") * F.col("cross_section")), "von_mises": F.sqrt(F.col("tensile") * F.col("tensile") + F.col("tensile") * F.col("compressive") + F.col("compressive") * F.col("compressive"))})
    safety = F.try_divide("yield_strength", "von_mises")
    return stressed.select("id", "stiffness", "yield_strength", "cross_section", "stress", "tensile", "compressive", "von_mises", safety.alias("safety"), zone(safety).alias("zone"))


def relax(loads: DataFrame, edges: DataFrame, damping: float = 0.5, tolerance: float = 1e-9, rounds: int = 100) -> tuple[DataFrame, int, float]:
    """(id, stress) of a load case, the rounds taken and the last residual.

    loads is (id, pressure); edges (source, target, weight), taken in both directions.  A node's stress is its own
    pressure and a share of its neighbours' stress by weight.  The share is damping over the largest sum of a node's
    weights (or over 1), so each round shrinks the residual by damping at least, whatever the graph; it ends when no
    stress moves by more than tolerance, and raises where `rounds` don't suffice.  Nodes in neither table don't appear.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping is from 0 to below 1")
    ends = edges.where("source <> target").select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("to")), F.struct(F.col("target").alias("id"), F.col("source").alias("to")))).alias("e"), "weight")
    ways = cut(ends.groupBy("e.id", "e.to").agg(F.sum("weight").alias("w")))
    most = ways.groupBy("id").agg(F.sum("w").alias("w")).agg(F.max("w")).first()[0] or 0.0
    share = damping / max(most, 1.0)
    own = cut(ways.select("id", F.lit(0.0).alias("p")).union(loads.select("id", F.col("pressure").cast("double"))).groupBy("id").agg(F.sum("p").alias("p")))
    now = own.select("id", F.col("p").alias("stress"))
    for i in range(1, rounds + 1):
        gets = ways.join(now.select(F.col("id").alias("to"), "stress"), "to").select("id", (F.col("w") * F.col("stress") * share).alias("s"), F.lit(0.0).alias("was"))
        new = cut(gets.union(own.select("id", "p", F.lit(0.0))).union(now.select("id", F.lit(0.0), "stress")).groupBy("id").agg(F.sum("s").alias("stress"), F.sum("was").alias("was")))
        residual = new.agg(F.max(F.abs(F.col("stress") - F.col("was")))).first()[0] or 0.0
        now = new.select("id", "stress")
        if residual <= tolerance:
            return now, i, residual
    raise ValueError(f"{rounds} rounds leave a residual of {residual}")


def single_file(path: str, pressure: float = 1.0) -> Column:
    """The load case of one file, as a pressure by id."""
    return F.when(F.col("id") == path, pressure).otherwise(0.0)


def module_change(prefix: str, pressure: float = 1.0) -> Column:
    """The load case of all that is below a folder."""
    return F.when(F.startswith("id", F.lit(prefix)), pressure).otherwise(0.0)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, before, after, change) of two stress fields; a node missing in one is under no stress there."""
    both = before.select("id", F.col("stress").alias("before")).join(after.select("id", F.col("stress").alias("after")), "id", "full")
    return both.na.fill(0.0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))
