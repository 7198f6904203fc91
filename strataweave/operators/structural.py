"""The structural layer: parsed files to module, class and function nodes, contains edges and resolved imports.

parsed is (file_path, language, loc, functions, classes, imports), the arrays as in schema.FILE_ANALYSIS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NODES, as_schema


def lines_of_code(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "")).cast("int")


def script_block(text: Column) -> Column:
    """(content, line): the first script element's content and the number of lines before it; null without one."""
    block = F.regexp_extract(text, r"(?si)<script([^>]*)>(.*?)</script>", 2)
    whole = F.regexp_extract(text, r"(?si)(<script[^>]*>).*?</script>", 1)
    before = F.regexp_extract(text, r"(?si)^(.*?<script[^>]*>).*?</script>", 1)
    return F.when(whole != "", F.struct(block.alias("content"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).alias("line")))


def members(parsed: DataFrame) -> DataFrame:
    """(file_path, language, kind, name, line_start, line_end, complexity), one row for each function and class."""

    def of(column: str, kind: str) -> DataFrame:
        return parsed.select("file_path", "language", F.lit(kind).alias("kind"), F.inline(column))

    return of("functions", "function").union(of("classes", "class"))


def module_nodes(parsed: DataFrame) -> DataFrame:
    """A module's complexity is the sum over its members; null if that is 0."""
    total = sum(F.aggregate(F.coalesce(c, F.array().cast("array<struct<name:string,line_start:int,line_end:int,complexity:int>>")), F.lit(0), lambda a, m: a + m["complexity"]) for c in ("functions", "classes"))
    return as_schema(parsed.select(F.col("file_path").alias("id"), F.lit("module").alias("type"), "file_path", "language", "loc", F.nullif(total, F.lit(0)).alias("complexity")), NODES)


def member_nodes(found: DataFrame) -> DataFrame:
    named = found.withColumn("id", F.concat_ws("::", "file_path", "name")).withColumn("type", F.col("kind"))
    return as_schema(named.withColumn("loc", F.col("line_end") - F.col("line_start") + 1), NODES)


def contains_edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("file_path").alias("source"), F.concat_ws("::", "file_path", "name").alias("target"), F.lit("structural").alias("layer"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))


def ancestors(path: Column) -> Column:
    """All folders above a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))).otherwise(F.array().cast("array<string>"))


def _place(wanted: DataFrame) -> list[str]:
    return ["edge_seq"] if "edge_seq" in wanted.columns else []


def folder_imports(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """(source, target) for imports of folders: every module below one, but not the importer itself.

    Modules are joined by each of their folders, so that the prefix match is an equi-join.
    """
    below = modules.select(F.col("id").alias("target"), F.explode(ancestors(F.col("id"))).alias("folder"))
    return wanted.join(below, wanted["path"] == below["folder"]).where("source <> target").select("source", "target", *_place(wanted))


def direct_imports(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """(source, target) where the path is a module's, or else a package's with that name; one row for each import."""
    a, b = modules.select(F.col("id").alias("exact")), modules.select(F.col("id").alias("package"))
    init = F.when(F.col("path").endswith(".py"), F.concat(F.expr("substring(path, 1, length(path) - 3)"), F.lit("/__init__.py")))
    found = wanted.withColumn("init", init).join(a, F.col("path") == F.col("exact"), "left").join(b, F.col("init") == F.col("package"), "left")
    return found.select("source", F.coalesce("exact", "package").alias("target"), *_place(wanted)).where("target is not null")


def import_edges(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges of wanted (source, path, language, and edge_seq if known) to modules; others are dropped.  Repeated imports repeat."""
    kept = ["source", "path", *_place(wanted)]
    plain = direct_imports(wanted.where("language is null or language <> 'go'").select(*kept), modules)
    folders = folder_imports(wanted.where("language = 'go'").select(*kept), modules.where(F.col("id").endswith(".go")))
    return plain.union(folders).select("source", "target", F.lit("structural").alias("layer"), F.lit("imports").alias("edge_type"), F.lit(1.0).alias("weight"), *_place(wanted))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each id: that of the smallest prio, and of those the smallest by its other columns."""
    others = [c for c in nodes.columns if c not in ("id", "prio")]
    best = nodes.groupBy("id").agg(F.min(F.struct("prio", *others)).alias("n"))
    return best.select("id", *[F.col(f"n.{c}").alias(c) for c in others])


def build_structural(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed files; edges keep repeats, nodes of one id are one.

    An import edge's edge_seq is its place among the imports of its file, so edges by source and edge_seq are in the order
    of the sources whichever task read them.
    """
    found = members(parsed)
    modules = module_nodes(parsed)
    nodes = first_nodes(modules.withColumn("prio", F.lit(0)).unionByName(member_nodes(found).withColumn("prio", F.lit(1))))
    wanted = parsed.select(F.col("file_path").alias("source"), "language", F.posexplode("imports").alias("edge_seq", "path"))
    return nodes, contains_edges(found).unionByName(import_edges(wanted, modules), allowMissingColumns=True)
