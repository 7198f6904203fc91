"""The nine signals.  Each takes the graph's frames and a one-row frame of limits, and gives schema.SIGNALS.

Limits are columns, so that they can be numbers of a Config or quantiles of the graph itself.  Where a rule takes the
first match of a walk over edges, first is by source, the place of the import in its file, and target.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.paths import is_cross_crate_pair, is_docs_example, is_generated_code, is_reexport_module, is_source_file, is_test_file, is_test_source_pair
from .metrics import node_metrics, percentile


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    change: DataFrame
    defect: DataFrame
    limits: DataFrame

    def layer(self, name: str) -> DataFrame:
        """The edges of one layer; a graph that keeps layers apart gives one without the others."""
        return self.edges.where(F.col("layer") == name)


def limits_of(nodes: DataFrame, thresholds: Thresholds) -> DataFrame:
    return nodes.sparkSession.range(1).select(*[F.lit(float(v)).alias(k) for k, v in asdict(thresholds).items()])


def with_limits(df: DataFrame, g: Graph) -> DataFrame:
    return df.join(F.broadcast(g.limits))  # one row


def undirected(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def structural_pairs(edges: DataFrame) -> DataFrame:
    return edges.where("layer = 'structural'").select(*undirected("source", "target")).distinct()


def edge_weights(edges: DataFrame, kind: str, name: str) -> DataFrame:
    """(lo, hi, from, name): an undirected pair's weight by one end; where both directions exist, each has its own."""
    own = edges.where(F.col("edge_type") == kind).groupBy("source", "target").agg(F.max("weight").alias("w"))
    ends = own.select("source", "target", "w", F.lit(0).alias("back")).union(own.select("target", "source", "w", F.lit(1)))
    return ends.groupBy(F.col("source").alias("from"), F.col("target").alias("to")).agg(F.min_by("w", "back").alias(name))


def imports(g: Graph) -> DataFrame:
    return g.layer("structural").where("edge_type = 'imports'").select("source", "target")


def _signal(df: DataFrame, kind: str, a: str, b: str | None, severity: Column, text: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("signal_type"), F.col(a).alias("node_a"), (F.col(b) if b else F.lit(None).cast("string")).alias("node_b"), severity.cast("double").alias("severity"), text.alias("description"))


def shared_importers(g: Graph) -> DataFrame:
    """(lo, hi, n): how many modules import both."""
    by = imports(g).distinct()
    both = by.toDF("source", "a").join(by.toDF("source", "b"), "source").where("a < b")
    return both.groupBy(F.col("a").alias("lo"), F.col("b").alias("hi")).agg(F.count("*").alias("n"))


def shared_importers_of(pairs: DataFrame, by: DataFrame) -> DataFrame:
    """pairs (lo, hi) with n, the modules that import both: only these pairs' importers are met."""
    by = by.distinct()
    left = pairs.select("lo", "hi").join(by.toDF("source", "lo"), "lo")
    return left.join(by.toDF("source", "hi"), ["source", "hi"]).groupBy("lo", "hi").agg(F.count("*").alias("n"))


def ghost_coupling(g: Graph) -> DataFrame:
    """Files that change together without a structural edge; explained pairs only if the coupling is very high, at less severity."""
    pairs = with_limits(g.layer("change").where("edge_type = 'co_changes'"), g).where(F.col("weight") > F.col("ghost_coupling"))
    pairs = pairs.where(~is_test_source_pair(F.col("source"), F.col("target")) & is_source_file(F.col("source")) & is_source_file(F.col("target")))
    pairs = pairs.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")}).join(structural_pairs(g.layer("structural")), ["lo", "hi"], "left_anti")
    explained = shared_importers_of(pairs.select("lo", "hi").distinct(), imports(g)).select("lo", "hi", F.lit(True).alias("shared"))
    judged = pairs.join(explained, ["lo", "hi"], "left").withColumn("less", F.coalesce("shared", F.lit(False)) | is_cross_crate_pair(F.col("source"), F.col("target")))
    kept = judged.where(~F.col("less") | (F.col("weight") >= F.col("ghost_coupling_high")))
    severity = F.when(F.col("less"), F.col("weight") * F.col("ghost_reduction")).otherwise(F.col("weight"))
    return _signal(kept, "ghost_coupling", "source", "target", severity, F.format_string("change together in %.0f%% of commits without a structural edge", F.col("weight") * 100))


def fragile_boundary(g: Graph) -> DataFrame:
    """Structural, coupled and fault-prone at once."""
    pairs = with_limits(g.layer("change").where("edge_type = 'co_changes'"), g).where(F.col("weight") > F.col("fragile_coupling")).withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})
    pairs = pairs.join(structural_pairs(g.layer("structural")), ["lo", "hi"], "left_semi")
    faults = edge_weights(g.layer("defect"), "fault_propagates", "fault")
    found = pairs.join(faults, (pairs["source"] == faults["from"]) & (pairs["target"] == faults["to"])).where(F.col("fault") > F.col("fragile_fault"))
    return _signal(found, "fragile_boundary", "source", "target", F.col("weight") * F.col("fault") * 10, F.format_string("coupling %.2f, fault propagation %.2f", "weight", "fault"))


def _gated_imports(g: Graph) -> DataFrame:
    """The first import of each unordered pair whose ends hardly change together, with what is known of its target."""
    kept = imports(g).where(~is_reexport_module(F.col("source")) & ~is_reexport_module(F.col("target")) & ~is_docs_example(F.col("source")) & ~is_docs_example(F.col("target")))
    first = kept.groupBy(*undirected("source", "target")).agg(F.min(F.struct("source", "target")).alias("e")).select("e.source", "e.target")
    w = edge_weights(g.layer("change"), "co_changes", "w")
    gated = first.join(w, (first["source"] == w["from"]) & (first["target"] == w["to"]), "left").select("source", "target", F.coalesce("w", F.lit(0.0)).alias("w"))
    gated = with_limits(gated, g).where(F.col("w") < F.col("over_engineering"))
    fan_in = imports(g).groupBy("target").agg(F.count("*").alias("importers"))
    target = g.nodes.select(F.col("id").alias("target"), "complexity")
    freq = g.change.select(F.col("node_id").alias("target"), "change_freq")
    known = gated.join(fan_in, "target", "left").join(target, "target", "left").join(freq, "target", "left")
    single = (F.col("importers") == 1) & (F.coalesce("complexity", F.lit(0)) <= F.col("over_engineering_complexity")) & (F.coalesce("change_freq", F.lit(0)) <= F.col("over_engineering_freq"))
    return known.withColumn("single", single)


def over_engineering_single(g: Graph) -> DataFrame:
    found = _gated_imports(g).where("single")
    return _signal(found, "over_engineering", "source", "target", F.lit(0.4), F.lit("only one module imports a small, quiet module"))


def over_engineering_pass_through(g: Graph) -> DataFrame:
    """A imports B imports C, A and C change together, B and C hardly do: of each A and B the C that B imports first."""
    rest = _gated_imports(g).where("not single").select("source", "target", "over_engineering", "pass_through_coupling")
    structural = g.layer("structural").where("edge_type = 'imports'")
    place = F.col("edge_seq") if "edge_seq" in structural.columns else F.lit(None).cast("long")
    onward = structural.groupBy(F.col("source").alias("target"), F.col("target").alias("c")).agg(F.min(place).alias("place"))
    w = edge_weights(g.layer("change"), "co_changes", "w")
    path = rest.join(onward, "target").where("c <> source")
    path = path.join(w.toDF("source", "c", "w_ac"), ["source", "c"]).where(F.col("w_ac") > F.col("pass_through_coupling"))
    path = path.join(w.toDF("target", "c", "w_bc"), ["target", "c"], "left").where(F.coalesce("w_bc", F.lit(0.0)) < F.col("over_engineering"))
    first = path.groupBy("source", "target").agg(F.min(F.struct("place", "c", "w_ac")).alias("m")).select("source", "target", "m.c", "m.w_ac")
    return _signal(first, "over_engineering", "source", "target", F.col("w_ac") * 0.5, F.concat(F.lit("Pass-through to "), F.col("c")))


def over_engineering(g: Graph) -> DataFrame:
    return over_engineering_single(g).unionByName(over_engineering_pass_through(g))


def stable_core(g: Graph) -> DataFrame:
    """Rarely changed, much used: frequency in the lowest, fan-in in the highest percentiles."""
    metrics = node_metrics(g.nodes, g.layer("structural"))
    t = g.limits.select("stable_core_freq", "stable_core_fan_in").first()
    low = g.change.agg(percentile("change_freq", t["stable_core_freq"]).alias("low"))
    high = metrics.agg(percentile("fan_in", t["stable_core_fan_in"]).alias("high"))
    known = g.change.select(F.col("node_id").alias("id"), "change_freq").join(metrics, "id").join(F.broadcast(low)).join(F.broadcast(high))
    found = known.where((F.col("change_freq") > 0) & (F.col("change_freq") <= F.col("low")) & (F.col("high") > 0) & (F.col("fan_in") >= F.col("high")) & ~is_test_file(F.col("id")) & ~is_docs_example(F.col("id")))
    return _signal(found, "stable_core", "id", None, F.lit(0.1), F.format_string("changed %d times, used %d times", "change_freq", "fan_in"))


def ticking_bomb(g: Graph) -> DataFrame:
    """Hot, buggy and coupled at once, each beyond a percentile that isn't 0."""
    t = g.limits.select("bomb_hotspot", "bomb_defect", "bomb_coupling").first()
    change = g.change.agg(percentile("hotspot_score", t["bomb_hotspot"]).alias("h"), percentile("sum_coupling", t["bomb_coupling"]).alias("c"))
    defect = g.defect.agg(percentile("defect_density", t["bomb_defect"]).alias("d"))
    known = g.nodes.select(F.col("id").alias("node_id")).join(g.change, "node_id").join(g.defect, "node_id").join(F.broadcast(change)).join(F.broadcast(defect))
    found = known.where("h > 0 and d > 0 and c > 0 and hotspot_score > h and defect_density > d and sum_coupling > c")
    return _signal(found, "ticking_bomb", "node_id", None, F.col("hotspot_score") * F.col("defect_density") * 10, F.format_string("hotspot %.2f, defect density %.3f", "hotspot_score", "defect_density"))


def dependency_cycle(g: Graph, groups: DataFrame | None = None) -> DataFrame:
    """Strongly connected groups of source files with a structural edge inside; groups is (id, component), if known."""
    from .components import strong_components

    groups = strong_components(g.edges) if groups is None else groups
    good = groups.groupBy("component").agg(F.count("*").alias("n"), F.min(is_source_file(F.col("id")) & ~is_generated_code(F.col("id"))).alias("ok"), F.min_by("id", "id").alias("node_a"), F.try_element_at(F.array_sort(F.collect_list("id")), F.lit(2)).alias("node_b")).where("n > 1 and ok")
    inside = g.layer("structural").join(groups.toDF("source", "component"), "source").join(groups.toDF("target", "component_"), "target").where("component = component_").select("component").distinct()
    found = good.join(inside, "component", "left_semi")
    return _signal(found, "dependency_cycle", "node_a", "node_b", F.col("n") * 0.5, F.format_string("a cycle of %d nodes", "n"))


def god_module(g: Graph) -> DataFrame:
    known = with_limits(g.nodes.select("id", "complexity", "loc").join(node_metrics(g.nodes, g.layer("structural")).select("id", "cbo"), "id"), g)
    found = known.where((F.col("complexity") >= F.col("god_complexity")) & (F.col("loc") >= F.col("god_loc")) & (F.col("cbo") >= F.col("god_cbo")) & ~is_test_file(F.col("id")) & ~is_generated_code(F.col("id")))
    severity = F.col("complexity") / 50.0 * (F.col("loc") / 500.0) * (F.col("cbo") / 15.0)
    return _signal(found, "god_module", "id", None, severity, F.format_string("complexity %d, %d lines, depends on %d files", "complexity", "loc", "cbo"))


def breadths(edges: DataFrame) -> DataFrame:
    """(id, breadth): co-change edges at each end."""
    ends = edges.where("edge_type = 'co_changes'").select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("breadth"))


def shotgun_surgery(g: Graph) -> DataFrame:
    found = with_limits(breadths(g.layer("change")), g).where((F.col("breadth") >= F.col("shotgun_breadth")) & is_source_file(F.col("id")) & ~is_test_file(F.col("id")))
    return _signal(found, "shotgun_surgery", "id", None, F.col("breadth") / F.col("shotgun_breadth"), F.format_string("changes with %d files", "breadth"))


def unstable_dependency(g: Graph) -> DataFrame:
    """Stable modules that import unstable ones; repeated imports repeat."""
    i = node_metrics(g.nodes, g.layer("structural")).select("id", "instability")
    e = with_limits(imports(g).join(i.toDF("source", "ia"), "source").join(i.toDF("target", "ib"), "target"), g).withColumn("gap", F.col("ib") - F.col("ia"))
    a, b = F.col("source"), F.col("target")
    found = e.where((F.col("gap") >= F.col("unstable_gap")) & (F.col("ia") < F.col("unstable_from")) & (F.col("ib") > F.col("unstable_to")) & is_source_file(a) & is_source_file(b) & ~is_test_file(a) & ~is_reexport_module(a) & ~is_reexport_module(b))
    return _signal(found, "unstable_dependency", "source", "target", F.col("gap"), F.format_string("instability %.2f depends on %.2f", "ia", "ib"))


DETECTORS = {
    "ghost_coupling": ghost_coupling,
    "fragile_boundary": fragile_boundary,
    "over_engineering": over_engineering,
    "stable_core": stable_core,
    "ticking_bomb": ticking_bomb,
    "dependency_cycle": dependency_cycle,
    "god_module": god_module,
    "shotgun_surgery": shotgun_surgery,
    "unstable_dependency": unstable_dependency,
}


def ordered(signals: DataFrame) -> DataFrame:
    return signals.orderBy(F.desc("severity"), "signal_type", "node_a", F.asc_nulls_first("node_b"))


def detect_signals(g: Graph) -> DataFrame:
    """All signals, most severe first."""
    return ordered(reduce(DataFrame.unionByName, [f(g) for f in DETECTORS.values()]))
