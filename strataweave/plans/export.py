"""Exports: DOT, Mermaid and JSON as ordered lines, which become one text or a folder of parts.

Their words, colours and signs are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import decimals, dot_style, heat_color, mermaid_arrow, mermaid_id


#: The order of lines: their section, then keys inside it.
ORDER = ("section", "k1", "k2", "k3", "k4")


def _lines(df: DataFrame, section: int, line: Column | str, k1: Column | None = None, *keys: Column | str) -> DataFrame:
    """Rows of ORDER and line."""
    given = [F.lit(0.0) if k1 is None else k1.cast("double"), *keys, *[F.lit("")] * (3 - len(keys))]
    return df.select(F.lit(section).alias("section"), *[F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("") if i else F.lit(0.0)).alias(f"k{i + 1}") for i, k in enumerate(given)], (F.col(line) if isinstance(line, str) else line).alias("line"))


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    """Lines that every export of a format has."""
    return spark.createDataFrame([(section, float(i), "", "", "", line) for i, line in enumerate(lines)], "section int, k1 double, k2 string, k3 string, k4 string, line string")


def as_text(lines: DataFrame) -> DataFrame:
    """One row: all lines as one text, for exports that fit one."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, "line"))), lambda x: x["line"])
    return lines.agg(F.array_join(ordered, "\n").alias("text"))


def write_parts(lines: DataFrame, path: str, parts: int) -> None:
    """The same text in up to `parts` files, which one behind the other in the order of their names are the whole.

    Lines are dealt by ranges of their order, so no task holds more than its part, and a file ends where a line does.
    """
    lines.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER, "line").select("line").write.mode("overwrite").text(path)


def _linked(signals: DataFrame, section: int, line: Column) -> DataFrame:
    return _lines(signals.where("node_b is not null"), section, line, -F.col("severity"), "signal_type", "node_a", "node_b")


def _score(c: str) -> Column:
    return decimals(F.col(c), 2)


def dot_lines(hotspots: DataFrame, signals: DataFrame) -> DataFrame:
    """Hotspots as boxes, by colour; signals of two nodes as edges, by style."""
    label = F.replace("id", F.lit('"'), F.lit('\\"'))
    box = F.concat(F.lit('  "'), "id", F.lit('" [label="'), label, F.lit("\\n"), _score("score"), F.lit('", style=filled, fillcolor='), heat_color(F.col("score")), F.lit("];"))
    edge = F.concat(F.lit('  "'), "node_a", F.lit('" -> "'), "node_b", F.lit('" ['), dot_style(F.col("signal_type")), F.lit(', label="'), "signal_type", F.lit('"];'))
    spark = hotspots.sparkSession
    return _fixed(spark, 0, "digraph layers {", "  rankdir=LR;", "  node [shape=box];").union(_lines(hotspots, 1, box, -F.col("score"), "id")).union(_linked(signals, 2, edge)).union(_fixed(spark, 3, "}"))


def dot(hotspots: DataFrame, signals: DataFrame) -> DataFrame:
    return as_text(dot_lines(hotspots, signals))


def mermaid_lines(hotspots: DataFrame, signals: DataFrame) -> DataFrame:
    label = F.replace("id", F.lit('"'), F.lit(""))
    hot = F.col("score") > 0.7
    box = F.concat(F.lit("  "), mermaid_id(F.col("id")), F.lit('["'), label, F.lit("\\n"), F.when(hot, "🔥 ").otherwise(""), _score("score"), F.lit('"]'), F.when(hot, ":::hot").otherwise(""))
    edge = F.concat(F.lit("  "), mermaid_id(F.col("node_a")), F.lit(" "), mermaid_arrow(F.col("signal_type")), F.lit("|"), "signal_type", F.lit("| "), mermaid_id(F.col("node_b")))
    spark = hotspots.sparkSession
    return _fixed(spark, 0, "graph LR").union(_lines(hotspots, 1, box, -F.col("score"), "id")).union(_linked(signals, 2, edge)).union(_fixed(spark, 3, "  classDef hot fill:#f96,stroke:#333"))


def mermaid(hotspots: DataFrame, signals: DataFrame) -> DataFrame:
    return as_text(mermaid_lines(hotspots, signals))


def _listed(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))


def viz_json_lines(viz: DataFrame, edges: DataFrame, signals: DataFrame, info: DataFrame) -> DataFrame:
    """The viewer's document: meta, nodes, edges and signals, an element a line.

    viz is of plans.queries.viz_nodes, best for a document; details that are JSON objects become objects.
    """
    spark = viz.sparkSession
    told = info.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("i"))  # a few keys
    said = [F.coalesce(F.col("i")[key], F.lit("")).alias(name) for key, name in (("repo_path", "repo"), ("commit", "commit"), ("last_build", "built_at"), ("time_window", "time_window"))]
    meta = told.join(viz.agg(F.count("*").alias("file_count"))).join(signals.agg(F.count("*").alias("signal_count"))).select(F.struct(*said, "file_count", "signal_count").alias("meta"))
    e = edges.select("source", "target", "layer", F.col("edge_type").alias("type"), "weight", _object(edges, "metadata").alias("metadata"))
    s = signals.select((-F.col("severity")).alias("k"), F.to_json(F.struct(F.col("signal_type").alias("type"), "node_a", "node_b", "severity", F.coalesce("description", F.lit("")).alias("detail"), _object(signals, "details").alias("evidence"))).alias("json"))
    zero = F.lit(0.0).alias("k")
    out = _lines(meta, 0, F.concat(F.lit('{"meta":'), F.to_json("meta"), F.lit(',"nodes":[')))
    out = out.union(_elements(viz.select(zero, F.to_json(F.struct(*viz.columns)).alias("json")), 1)).union(_fixed(spark, 2, '],"edges":['))
    out = out.union(_elements(e.select(zero, F.to_json(F.struct(*e.columns)).alias("json")), 3)).union(_fixed(spark, 4, '],"signals":['))
    return out.union(_elements(s, 5)).union(_fixed(spark, 6, "]}"))


def viz_json(viz: DataFrame, edges: DataFrame, signals: DataFrame, info: DataFrame) -> DataFrame:
    return as_text(viz_json_lines(viz, edges, signals, info))


def _elements(rows: DataFrame, section: int) -> DataFrame:
    """Lines of a JSON array's elements (k, json): all but the first have a comma in front.

    Equal elements are counted, so which one is first needs the least row alone and no order over all of them.
    """
    counted = rows.groupBy("k", "json").count()
    least = counted.agg(F.min(F.struct("k", "json")).alias("least"))  # one row
    each = counted.join(F.broadcast(least)).select("k", "json", (F.struct("k", "json") == F.col("least")).alias("lead"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))
    first = F.col("lead") & (F.col("nth") == 1)
    return _lines(each, section, F.when(first, F.col("json")).otherwise(F.concat(F.lit(","), "json")), F.col("k"), "json", F.when(first, "").otherwise("x"))


def _object(df: DataFrame, name: str) -> Column:
    """A column of JSON objects as maps; null where there is none."""
    return F.from_json(F.col(name).cast("string"), "map<string,string>") if name in df.columns else F.lit(None).cast("map<string,string>")


def load_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, signals) of viewer documents: JSON files with those lists."""
    raw = spark.read.option("multiLine", "true").json(path)
    return tuple(raw.select(F.inline(name)) for name in ("nodes", "edges", "signals"))


def summary_json(stats: DataFrame, signals: DataFrame, hotspots: DataFrame) -> DataFrame:
    return stats.select(F.struct("*").alias("stats")).join(_listed(signals, "signals")).join(_listed(hotspots.withColumn("k1", -F.col("score")), "hotspots")).select(F.to_json(F.struct("stats", "signals", "hotspots")).alias("text"))
