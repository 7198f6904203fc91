"""Extension: which nodes words lead to.  An inverted index over identifiers, ranked, and spread along the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much of a node's own match its neighbours get, by structure and (times the coupling) by change.
STRUCTURAL, TEMPORAL = 0.25, 0.5


def parts_of(text: Column) -> Column:
    """Lower-case words of an identifier: letters and digits apart, capitals beginning a word, as in parseHTMLPage2."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.regexp_extract_all(F.lower(apart), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def index(nodes: DataFrame) -> DataFrame:
    """(term, id, tf): how often a term stands in a node's identifier.  Stored or cached, it answers any number of questions."""
    return nodes.select("id", F.explode(parts_of(F.col("id"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def matches(postings: DataFrame, intent: str) -> DataFrame:
    """(id, own): the sum of (1 + ln tf) ln(1 + n / df) over the terms of intent; nodes without one have no row."""
    asked = postings.sparkSession.createDataFrame([(intent,)], "intent string").select(F.explode(F.array_distinct(parts_of(F.col("intent")))).alias("term"))
    hits = postings.join(F.broadcast(asked), "term")  # an intent's words
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = postings.agg(F.countDistinct("id").alias("n"))
    weight = (1 + F.ln(F.col("tf").cast("double"))) * F.ln(1 + F.col("n") / F.col("df"))
    return hits.join(F.broadcast(df), "term").join(F.broadcast(n)).groupBy("id").agg(F.sum(weight).alias("own"))


def ranked(postings: DataFrame, edges: DataFrame, change: DataFrame, intent: str, top: int | None = None) -> DataFrame:
    """(id, own, score): nodes by what they match themselves and what their neighbours pass on, times 1 + hotspot score.

    Structural and co-change edges pass on in both directions; parallel edges each do.  Equal scores go by id.
    """
    own = matches(postings, intent)
    share = F.when(F.col("layer") == "structural", STRUCTURAL).otherwise(TEMPORAL * F.col("weight"))
    ways = edges.where("source <> target and (layer = 'structural' or edge_type = 'co_changes')").select("source", "target", share.alias("share"))
    both = ways.union(ways.select("target", "source", "share"))
    passed = both.join(own.select(F.col("id").alias("source"), "own"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("own") * F.col("share")).alias("passed"))
    hot = change.select(F.col("node_id").alias("id"), "hotspot_score")
    both = own.join(passed, "id", "full").join(hot, "id", "left").na.fill(0.0, ["own", "passed", "hotspot_score"])
    out = both.select("id", "own", ((F.col("own") + F.col("passed")) * (1 + F.col("hotspot_score"))).alias("score"))
    ordered = out.orderBy(F.desc(F.round("score", 9)), "id")
    return ordered if top is None else ordered.limit(top)
