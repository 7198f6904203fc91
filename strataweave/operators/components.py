"""Strongly connected components: shrinking, then searches forward and backward from pivots, for all parts of a graph at once.

Shrinking takes away nodes without a way in or a way out, which are on no cycle, and nodes with one of each, whose two
neighbours are then joined: such a node belongs to a component if both of its neighbours belong to it.  Of neighbouring
ones those go whose hash is the least, so a chain of any length is gone in logarithmically many rounds.

Then the graph falls into parts, one at first.  In each round every part has a pivot.  What the pivot reaches and is
reached from is its component; what is only reached, what only reaches and the rest are three smaller parts, and no
component lies in two of them, so edges between parts go.  A node enters a front once in each direction, so a round's
joins together have no more rows than the edges have twice over, however dense they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Shrinking goes on while so many of the nodes fall away at a time, or any in a chain.
SHRINKS = 0.1


def degrees(edges: DataFrame) -> DataFrame:
    """(part, id, outs, ins, succ, pred) of each node; succ and pred are a neighbour each way, the only one if there is one."""
    out = F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("target").alias("succ"), F.lit(None).cast("string").alias("pred"))
    into = F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast("string").alias("succ"), F.col("source").alias("pred"))
    ends = edges.select("part", F.explode(F.array(out, into)).alias("e")).select("part", "e.*")
    return ends.groupBy("part", "id").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"), F.max("succ").alias("succ"), F.max("pred").alias("pred"))


def shrunk(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """edges without dead ends and chains, and the chains' nodes as (id, pred, succ), a frame a round."""
    links = []
    while True:
        nodes = cut(degrees(edges))
        n, n_dead, n_chain = nodes.agg(F.count("*"), F.count_if(F.expr("outs = 0 or ins = 0")), F.count_if(F.expr("outs = 1 and ins = 1"))).first()
        if not n_chain and (not n_dead or n_dead < SHRINKS * n):
            return edges, links
        dead = nodes.where("outs = 0 or ins = 0").select("id")
        chain = nodes.where("outs = 1 and ins = 1").select("part", "id", "pred", "succ", F.struct(F.xxhash64("id", F.lit(len(links))).alias("h"), "id").alias("h"))
        ranks = chain.select(F.col("id").alias("n"), F.col("h").alias("other"))
        least = chain
        for side in ("pred", "succ"):  # a neighbour that isn't in a chain stays anyway
            least = least.join(ranks.select(F.col("n").alias(side), F.col("other").alias(f"h_{side}")), side, "left").where(F.col(f"h_{side}").isNull() | (F.col("h") < F.col(f"h_{side}")))
        gone, joined = dead, edges.select("source", "target", "part")
        if n_chain:
            link = cut(least.select("part", "id", "pred", "succ"))
            gone = dead.union(link.select("id"))
            joined = joined.union(link.where("pred <> succ").select("pred", "succ", "part"))
        edges = cut(joined.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti").select("source", "target", "part").distinct())
        if n_chain:
            links.append(link.select("id", "pred", "succ"))


def _search(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, ahead): what each part's pivot reaches (ahead) and what reaches it (not ahead), the pivot in both."""
    ways = cut(edges.select(F.lit(True).alias("ahead"), F.col("source").alias("id"), F.col("target").alias("next")).union(edges.select(F.lit(False), "target", "source")))
    front = cut(starts.select(F.col("pivot").alias("id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead")))
    fronts = [front]
    while True:
        reached = ways.join(front, ["id", "ahead"], "left_semi").select(F.col("next").alias("id"), "ahead").distinct()
        front = cut(reached.join(reduce(DataFrame.union, fronts), ["id", "ahead"], "left_anti"))
        if front.isEmpty():
            return reduce(DataFrame.union, fronts)
        fronts.append(front)
        if len(fronts) > 16:  # plans stay short however many fronts there are
            fronts = [cut(reduce(DataFrame.union, fronts))]


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes in strongly connected groups of two or more; component is the group's least id.

    edges has source and target; repeated edges, loops and null ends don't matter, and an empty table has no components.
    """
    left = cut(edges.where("source <> target").select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.lit("").alias("part")).distinct())
    left, links = shrunk(left)
    found = []
    while not left.isEmpty():
        # a node with many edges both in and out; of equals the one whose name comes last
        starts = cut(degrees(left).groupBy("part").agg(F.max_by("id", F.struct(F.least("outs", "ins"), F.greatest("outs", "ins"), "id")).alias("pivot")))
        seen = _search(left, starts).groupBy("id").agg(F.max("ahead").alias("f"), F.max(~F.col("ahead")).alias("b"))
        nodes = left.select("part", F.col("source").alias("id")).union(left.select("part", "target")).distinct()
        side = F.when(F.col("f") & F.col("b"), "c").when(F.col("f"), "f").when(F.col("b"), "b").otherwise("n")
        # a pivot is one part's alone, so with a letter behind it names a new part
        named = cut(nodes.join(starts, "part").join(seen, "id", "left").select("id", "pivot", side.alias("side")).withColumn("part", F.concat("pivot", "side")))
        found.append(named.where("side = 'c'").select("id", F.col("pivot").alias("label")))
        placed = named.where("side <> 'c'").select("id", "part")
        left = cut(left.drop("part").join(placed.toDF("source", "part"), "source").join(placed.toDF("target", "other"), "target").where("part = other").select("source", "target", "part"))
        if not left.isEmpty():
            left, more = shrunk(left)
            links += more
    labels = reduce(DataFrame.union, found) if found else edges.sparkSession.createDataFrame([], "id string, label string")
    for link in reversed(links):  # a node of no component is its own label, which no component has
        ends = link
        for side in ("pred", "succ"):
            ends = ends.join(labels.select(F.col("id").alias(side), F.col("label").alias(f"l_{side}")), side, "left").withColumn(f"l_{side}", F.coalesce(f"l_{side}", side))
        inner = ends.where("l_pred = l_succ").select("id", F.col("l_pred").alias("label"), (F.col("pred") == F.col("succ")).alias("loop"))
        # the two nodes of a loop that was all of its component have no label yet
        fresh = inner.where("loop").select(F.col("label").alias("id"), "label").distinct().join(labels, "id", "left_anti")
        labels = cut(labels.union(inner.select("id", "label")).union(fresh.where("id = label")))
    names = labels.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return labels.join(names, "label").select("id", "component")


def component_of(edges: DataFrame, node: str) -> DataFrame:
    """The rows of strong_components of the node's own component, none if it is in none: one search each way."""
    left = cut(edges.where("source <> target").select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).distinct())
    seen = _search(left, left.sparkSession.range(1).select(F.lit(node).alias("pivot")))
    both = cut(seen.groupBy("id").agg(F.max("ahead").alias("f"), F.max(~F.col("ahead")).alias("b")).where("f and b").select("id"))
    least = both.agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")  # one row
    return both.join(F.broadcast(least)).select("id", "component")


def linked_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes linked in either direction, through others as well; component is the group's least id.

    A round links every node's larger neighbours to its least one, and then every node and its smaller neighbours to the
    least of these, so the longest path about halves, and there are never more edges than before.  It ends when every node
    has one smaller neighbour, which has none.  Repeated edges, loops and null ends don't matter.
    """
    ends = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
    left = cut(ends.distinct())
    while True:
        least = left.groupBy(F.col("v").alias("x")).agg(F.min("v").alias("m")).union(left.groupBy("u").agg(F.min("v"))).groupBy("x").agg(F.min("m").alias("m"))
        # the larger neighbours of a node are those that have it as their smaller end
        large = left.join(least, left["v"] == least["x"]).select("u", F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
        left = cut(small.distinct())
        # done when each node is under one other, which is under none
        if left.groupBy("u").count().where("count > 1").isEmpty() and left.join(left.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            roots = left.select(F.col("v").alias("id")).distinct()
            return left.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", "id"))
