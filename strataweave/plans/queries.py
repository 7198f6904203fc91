"""Fixed queries over the graph's tables: hotspots, impact, signals, stats, and what viewers derive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.display import SIGNAL_ORDER, derive_module
from ..operators.metrics import fans


def hotspots(nodes: DataFrame, change: DataFrame, top: int | None = None) -> DataFrame:
    """(id, score, change_freq, complexity): frequency times complexity, each by its largest; without a complexity it is 1."""
    known = nodes.select("id", "complexity").join(change.select(F.col("node_id").alias("id"), "change_freq"), "id").where("change_freq > 0")
    most = change.agg(F.max("change_freq").alias("_f")).join(nodes.agg(F.coalesce(F.max("complexity"), F.lit(1)).alias("_c")))  # one row
    score = F.coalesce(F.try_divide(F.col("change_freq"), F.col("_f")), F.lit(0.0)) * F.coalesce(F.try_divide(F.coalesce("complexity", F.lit(1)), F.col("_c")), F.lit(0.0))
    out = known.join(F.broadcast(most)).select("id", score.alias("score"), "change_freq", F.coalesce("complexity", F.lit(0)).alias("complexity"))
    return out if top is None else out.orderBy(F.desc("score"), "id").limit(top)


def rank_hotspots(nodes: DataFrame, change: DataFrame, top: int) -> DataFrame:
    """As hotspots, with the place of each."""
    best = hotspots(nodes, change, top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # at most top rows


def signals_where(signals: DataFrame, kind: str | None = None, at_least: float | None = None) -> DataFrame:
    if kind is not None:
        signals = signals.where(F.col("signal_type") == kind)
    if at_least is not None:
        signals = signals.where(F.col("severity") >= at_least)
    return signals.orderBy(F.desc("severity"), "signal_type", "node_a", F.asc_nulls_first("node_b"))


def search_signals(signals: DataFrame, kinds: tuple[str, ...], at_least: float, text: str) -> DataFrame:
    """A viewer's filter: type, severity, and text in either node whatever its case."""
    has = F.contains(F.lower("node_a"), F.lit(text.lower())) | F.coalesce(F.contains(F.lower("node_b"), F.lit(text.lower())), F.lit(False))
    return signals.where(F.col("signal_type").isin(*kinds) & (F.col("severity") >= at_least) & has)


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("id"), F.lit(text.lower())))


def get_node(nodes: DataFrame, node: str) -> DataFrame:
    """The node of an id, or no row."""
    return nodes.where(F.col("id") == node)


def get_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of the ids in wanted (id), each once however often it is wanted; unknown ids have no row."""
    return nodes.join(wanted.select("id").distinct(), "id", "left_semi")


def node_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("id").orderBy("id")


def edges_between(edges: DataFrame, a: str, b: str, kind: str | None = None) -> DataFrame:
    """Edges from a to b and, if there are none, from b to a."""
    both = edges.where(((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a)))
    both = both if kind is None else both.where(F.col("edge_type") == kind)
    ahead = both.agg(F.coalesce(F.max(F.col("source") == a), F.lit(False)).alias("_ahead"))  # one row
    return both.join(F.broadcast(ahead)).where((F.col("source") == a) == F.col("_ahead")).drop("_ahead")


def impact_rows(nodes: DataFrame, edges: DataFrame, signals: DataFrame, change: DataFrame, target: str) -> DataFrame:
    """(kind, name, about, value): all of impact, a row for each thing told; none for an unknown node but what edges say."""
    text = F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("double").alias("value")
    said = [
        get_node(nodes, target).select(F.lit("node").alias("kind"), F.col("id").alias("name"), F.col("type").alias("about"), F.lit(None).cast("double").alias("value")),
        impact_structural(edges, target).select(F.lit("dependency"), "target", "edge_type", number("weight")),
        impact_temporal(edges, target).select(F.lit("coupling"), "node", text, number("weight")),
        impact_signals(signals, target).select(F.concat(F.lit("signal:"), "signal_type"), "node_a", "node_b", number("severity")),
        *[change.where(F.col("node_id") == target).select(F.lit("metric"), F.lit(c), text, number(c)) for c in ("change_freq", "churn_lines", "hotspot_score", "sum_coupling")],
    ]
    out = said[0]
    for more in said[1:]:
        out = out.union(more)
    return out


def impact_structural(edges: DataFrame, target: str) -> DataFrame:
    return edges.where((F.col("source") == target) & (F.col("layer") == "structural")).select("target", "edge_type", "weight")


def impact_temporal(edges: DataFrame, target: str) -> DataFrame:
    """(node, weight) of co-changes at either end, without repeats, heaviest first."""
    co = edges.where("edge_type = 'co_changes'")
    ends = co.where(F.col("source") == target).select(F.col("target").alias("node"), "weight").union(co.where(F.col("target") == target).select("source", "weight"))
    return ends.distinct().orderBy(F.desc("weight"), "node")


def impact_signals(signals: DataFrame, target: str) -> DataFrame:
    return signals.where((F.col("node_a") == target) | F.coalesce(F.col("node_b") == target, F.lit(False)))


def impact(nodes: DataFrame, edges: DataFrame, signals: DataFrame, change: DataFrame, target: str) -> DataFrame:
    """One row: whether the node exists, what it depends on, what it changes with, its signals and change metrics; empty lists for an unknown one."""
    known = nodes.where(F.col("id") == target).agg((F.count("*") > 0).alias("exists"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))

    out = known.join(listed(impact_structural(edges, target), "dependencies")).join(listed(impact_temporal(edges, target), "couplings")).join(listed(impact_signals(signals, target).select("signal_type", "node_a", "node_b", "severity"), "signals"))
    mine = change.where(F.col("node_id") == target).agg(F.first(F.struct(*change.columns)).alias("metrics"))
    return out.join(mine)


def stats(nodes: DataFrame, edges: DataFrame, signals: DataFrame) -> DataFrame:
    """One row of counts, a pass for each table."""
    e = edges.agg(F.count("*").alias("total_edges"), F.count_if(F.col("layer") == "structural").alias("structural_edges"), F.count_if(F.col("layer") == "change").alias("change_edges"), F.count_if(F.col("layer") == "defect").alias("defect_edges"))
    return nodes.agg(F.count("*").alias("total_nodes")).join(e).join(signals.agg(F.count("*").alias("total_signals")))


def common_prefix(paths: DataFrame, path: str = "file_path", by: str | None = None) -> DataFrame:
    """One row, or one for each value of column by: the longest folder that all paths are below.

    Only the least and greatest path matter.
    """
    groups = [by] if by else []
    ends = paths.groupBy(*groups).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    most = F.least(F.size(a), F.size(b)) - 1
    same = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: (i <= most) & (F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    return ends.select(*groups, F.coalesce(F.when(F.col("a").isNull(), "").otherwise(F.concat_ws("/", F.slice(a, F.lit(1), F.array_max(same)))), F.lit("")).alias("prefix"))


def viz_nodes(nodes: DataFrame, edges: DataFrame, change: DataFrame, defect: DataFrame, document: bool = False) -> DataFrame:
    """Every node with its module, fans and metrics, 0 where there are none; for a document with what else is known of it."""
    out = nodes.join(change.withColumnRenamed("node_id", "id"), "id", "left").join(defect.withColumnRenamed("node_id", "id"), "id", "left").join(fans(edges), "id", "left").join(F.broadcast(common_prefix(nodes)))
    zero = {"loc": 0, "complexity": 0, "change_freq": 0, "churn_rate": 0.0, "hotspot_score": 0.0, "sum_coupling": 0.0, "bug_count": 0, "defect_density": 0.0, "fan_in": 0, "fan_out": 0}
    more = []
    if document:
        zero |= {"nesting_depth": 0, "churn_lines": 0, "fix_inducing_rate": 0.0}
        more = [F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in ("file_path", "language", "last_changed")]
    numbers = [(F.coalesce(c, F.lit(v)) if c in out.columns else F.lit(v)).alias(c) for c, v in zero.items()]
    return out.withColumn("module", derive_module(F.col("file_path"), F.col("prefix"))).select("id", "type", "module", *more, *numbers)


RANKED = ("hotspot_score", "complexity", "churn_rate", "defect_density", "sum_coupling")


def percent_ranks(viz: DataFrame) -> DataFrame:
    """(id, a rank from 0 to 1 for each of five metrics): the share of nodes below.

    The five are ranked in one pass: values are counted by metric, and a metric's counts are summed up in blocks of
    neighbouring values, whose own sums then shift them, so no task holds a metric's values.
    """
    total = viz.agg((F.count("*") - 1).alias("n"))
    long = viz.select("id", F.posexplode(F.array(*[F.col(c).cast("double") for c in RANKED])).alias("m", "v"))
    counted = long.groupBy("m", "v").count()
    ends = counted.groupBy("m").agg(F.min("v").alias("low"), F.max("v").alias("high"))  # a row a metric
    place = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    rows = counted.join(F.broadcast(ends), "m").select("m", "v", "count", F.floor(place * RANK_BLOCKS).alias("b"))
    sums = rows.groupBy("m", "b").agg(F.sum("count").alias("s"))  # at most RANK_BLOCKS + 1 rows a metric
    shift = sums.select("m", "b", F.coalesce(F.sum("s").over(W.partitionBy("m").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    inside = F.coalesce(F.sum("count").over(W.partitionBy("m", "b").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = rows.withColumn("i", inside).join(F.broadcast(shift), ["m", "b"]).select("m", "v", (F.col("i") + F.col("s")).alias("below"))
    ranked = long.join(below, ["m", "v"]).groupBy("id").agg(*[F.max(F.when(F.col("m") == i, F.col("below"))).alias(c) for i, c in enumerate(RANKED)])
    return ranked.join(F.broadcast(total)).select("id", *[F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0)).alias(f"{c}_rank") for c in RANKED])


RANK_BLOCKS = 1024


def module_rollup(viz: DataFrame) -> DataFrame:
    """(module, n_nodes, value), largest first: a node's value is its lines, 1 at least."""
    return viz.groupBy("module").agg(F.count("*").alias("n_nodes"), F.sum(F.greatest("loc", F.lit(1))).alias("value")).orderBy(F.desc("value"), "module")


def max_values(viz: DataFrame) -> DataFrame:
    return viz.agg(*[F.max(c).alias(f"max_{c}") for c in ("hotspot_score", "complexity", "loc", "churn_rate", "sum_coupling", "defect_density", "change_freq")])


def dependency_summary(edges: DataFrame, at_least: float = 0.3) -> DataFrame:
    """(id, structural_out, structural_in, coupled, defects) of each node with edges; coupled counts weights above at_least."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(True).alias("out")), F.struct(F.col("target").alias("id"), F.lit(False).alias("out")))).alias("e"), "layer", "weight")
    s = F.col("layer") == "structural"
    return ends.groupBy("e.id").agg(F.count_if(s & F.col("e.out")).alias("structural_out"), F.count_if(s & ~F.col("e.out")).alias("structural_in"), F.count_if((F.col("layer") == "change") & (F.col("weight") > at_least)).alias("coupled"), F.count_if(F.col("layer") == "defect").alias("defects"))


def signal_counts(signals: DataFrame) -> DataFrame:
    """(signal_type, place, n) in the fixed order of types."""
    kinds = F.array(*[F.lit(k) for k in SIGNAL_ORDER])
    return signals.groupBy("signal_type").agg(F.count("*").alias("n")).withColumn("place", F.array_position(kinds, F.col("signal_type")).cast("int")).orderBy("place")


def signal_index(signals: DataFrame) -> DataFrame:
    """(node, signal_type, n): each signal under both of its nodes."""
    return signals.select(F.explode(F.array_compact(F.array("node_a", "node_b"))).alias("node"), "signal_type").groupBy("node", "signal_type").agg(F.count("*").alias("n"))


def edge_index(edges: DataFrame) -> DataFrame:
    """(node, layer, n): each edge under both ends, a loop twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("node"), "layer").groupBy("node", "layer").agg(F.count("*").alias("n"))


#: Signals whose pairs a viewer highlights.
HIGHLIGHTS = ("fragile_boundary", "ghost_coupling", "ticking_bomb")


def highlighted(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """Edges whose ends, in either direction, carry a fragile, ghost or bomb signal together."""
    pairs = signals.where(F.col("signal_type").isin(*HIGHLIGHTS) & F.col("node_b").isNotNull()).select(F.least("node_a", "node_b").alias("lo"), F.greatest("node_a", "node_b").alias("hi")).distinct()
    return edges.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")}).join(pairs, ["lo", "hi"], "left_semi").drop("lo", "hi")


def module_colors(viz: DataFrame, colors: int = 10) -> DataFrame:
    """(module, color): a palette's places in turn, modules by name."""
    return viz.select("module").distinct().withColumn("color", (F.row_number().over(W.orderBy("module")) - 1) % colors)
