"""Extension: changes inside files.  Hunks are attributed to symbols, which then change together and raise three signals.

symbols is (file, symbol, line_start, line_end), hunks (commit_id, file, old_lines, new_start, new_lines).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import change
from .components import linked_components
from .ranges import innermost

#: Lines of a bucket, in which ranges meet.
BUCKET = 64


def owned_ranges(symbols: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(file, symbol, a, b): disjoint ranges of lines, each with the innermost symbol around it; lines of none have no range.

    A range goes from one place where a symbol begins or ends to the next, so inside it the symbol is the same.
    """
    marks = symbols.select("file", F.explode(F.array(F.col("line_start"), F.col("line_end") + 1)).alias("a")).distinct()
    spans = marks.withColumn("b", F.lead("a").over(W.partitionBy("file").orderBy("a")) - 1).where("b is not null")
    return innermost(symbols, spans, "file", "line_start", "line_end", "a", "symbol", bucket).select("file", "symbol", "a", "b")


def hunk_parts(hunks: DataFrame, symbols: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(commit_id, file, node, lines): the parts of hunks by symbol, and by file what is outside all symbols.

    Names may be strings, or numbers that differ between files and symbols.  A hunk's lines are those it takes away and adds.  They are spread evenly over the lines it has afterwards (the one
    before the gap, if it only takes away), and each of these is its innermost symbol's.  Both kinds of ranges are cut at
    the borders of buckets, so an equi-join on file and bucket finds every overlap and none twice.  A bucket's ranges are
    gathered in one row, as they are disjoint and so no more than its lines; what they leave of a hunk's piece is the
    file's.  Hunks are thus shuffled once.
    """
    spans = hunks.select("commit_id", "file", (F.col("old_lines") + F.col("new_lines")).alias("changed"), F.greatest("new_start", F.lit(1)).alias("from"), F.greatest("new_lines", F.lit(1)).alias("n"))
    spans = spans.where("changed > 0").withColumn("to", F.col("from") + F.col("n") - 1)

    def cut_up(df: DataFrame, a: str, b: str) -> DataFrame:
        spread = df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
        return spread.withColumns({a: F.greatest(F.col(a), F.col("bucket") * bucket), b: F.least(F.col(b), (F.col("bucket") + 1) * bucket - 1)})

    ranges = cut_up(owned_ranges(symbols, bucket), "a", "b").groupBy("file", "bucket").agg(F.collect_list(F.struct("a", "b", "symbol")).alias("ranges"))
    met = cut_up(spans, "from", "to").join(ranges, ["file", "bucket"], "left")
    inside = F.filter(F.coalesce("ranges", F.array().cast(ranges.schema["ranges"].dataType)), lambda r: (r["a"] <= F.col("to")) & (F.col("from") <= r["b"]))
    parts = F.transform(inside, lambda r: F.struct(r["symbol"].alias("node"), (F.least(r["b"], F.col("to")) - F.greatest(r["a"], F.col("from")) + 1).alias("k")))
    left = F.col("to") - F.col("from") + 1 - F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["k"])
    owned = met.withColumn("parts", parts).withColumn("part", F.explode(F.concat("parts", F.array(F.struct(F.col("file").alias("node"), left.alias("k"))))))
    share = F.col("part.k") * F.col("changed") / F.col("n")
    return owned.where("part.k > 0").select("commit_id", "file", F.col("part.node").alias("node"), share.alias("lines"))


def attributed(hunks: DataFrame, symbols: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(commit_id, file, node, lines): each commit's changed lines by symbol, those outside all symbols by file."""
    parts = hunk_parts(hunks, symbols, bucket)
    return parts.groupBy("commit_id", "file", "node").agg(F.sum("lines").alias("lines")).where("node <> file or lines > 1e-6")


def symbol_touches(changes: DataFrame) -> DataFrame:
    """Touches of the change layer's form: a commit's part in one file is a commit there, and symbols are files."""
    return changes.where("node <> file").select(F.concat_ws("\n", "commit_id", "file").alias("commit_id"), F.col("node").alias("file"))


def symbol_couplings(changes: DataFrame, min_co_changes: int = 5, max_symbols: int = 50) -> DataFrame:
    """(file, a, b, cnt, w), a < b: symbols of one file that change together, by the share of the rarer one's commits."""
    touches = symbol_touches(changes)
    freq = touches.groupBy("file").agg(F.count("*").alias("change_freq"))
    coupled = change.couplings(change.co_change_pairs(touches, max_symbols), freq, min_co_changes)
    return coupled.join(changes.where("node <> file").select(F.col("node").alias("a"), F.col("file").alias("file")).distinct(), "a").select("file", "a", "b", "cnt", "w")


def hunk_couplings(hunks: DataFrame, symbols: DataFrame, min_co_changes: int = 5, max_symbols: int = 50, bucket: int = BUCKET) -> DataFrame:
    """As symbol_couplings of the hunks attributed; a symbol is of one file.

    Parts of hunks are shuffled once, by commit.  There a symbol counts with itself, which gives how often it changes, and
    with the others of its file, so both counts are shuffled together, and what is rare ends there.
    """
    parts = hunk_parts(hunks, symbols, bucket).where("node <> file").select("commit_id", "file", "node")
    own = parts.repartition("commit_id").groupBy("commit_id", "file").agg(F.sort_array(F.collect_set("node")).alias("own"))
    after = F.when(F.size("own") <= max_symbols, F.slice("own", F.col("i") + 1, F.size("own"))).otherwise(F.array("a"))
    pairs = own.select("own", F.posexplode("own").alias("i", "a")).select("a", F.explode(after).alias("b"))
    counted = cut(pairs.groupBy("a", "b").agg(F.count("*").alias("cnt")).where((F.col("a") == F.col("b")) | (F.col("cnt") >= min_co_changes)))
    freq = counted.where("a = b").select(F.col("a").alias("file"), F.col("cnt").alias("change_freq"))
    coupled = change.couplings(counted.where("a <> b"), freq, min_co_changes)
    return coupled.join(symbols.select(F.col("symbol").alias("a"), "file").distinct(), "a").select("file", "a", "b", "cnt", "w")


def co_change_edges(coupled: DataFrame, min_coupling: float = 0.3) -> DataFrame:
    """Edges between symbols of one file, marked by their scope."""
    kept = coupled.where(F.col("w") >= min_coupling)
    return kept.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("change").alias("layer"), F.lit("co_changes").alias("edge_type"), F.col("w").alias("weight"), F.lit('{"scope": "intra_file"}').alias("metadata"))


def hotspots(changes: DataFrame, symbols: DataFrame, times: float = 3.0, at_least: int = 5) -> DataFrame:
    """(node_a, severity): symbols that change more than `times` as often as their file's symbols do on average."""
    freq = changes.where("node <> file").groupBy(F.col("node").alias("symbol")).agg(F.count("*").alias("freq"))
    every = symbols.select("file", "symbol").distinct().join(freq, "symbol", "left").na.fill(0, ["freq"])
    mean = every.groupBy("file").agg(F.avg("freq").alias("mean"))
    found = every.join(mean, "file").where((F.col("freq") > times * F.col("mean")) & (F.col("freq") >= at_least))
    return found.select(F.col("symbol").alias("node_a"), (F.col("freq") / F.col("mean")).alias("severity"))


def hidden_couplings(coupled: DataFrame, edges: DataFrame, above: float = 0.5) -> DataFrame:
    """(node_a, node_b, severity): symbols that change together but have no structural edge in either direction."""
    known = edges.where("edge_type in ('contains', 'calls')").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return coupled.where(F.col("w") > above).join(known, ["a", "b"], "left_anti").select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("w").alias("severity"))


def clusters(coupled: DataFrame, at_least: float = 0.3) -> DataFrame:
    """(file, id, component): symbols linked by couplings of at_least, by group; symbols with no such link have none."""
    strong = coupled.where(F.col("w") >= at_least).select(F.col("a").alias("source"), F.col("b").alias("target"))
    groups = linked_components(strong)
    files = coupled.select("file", F.explode(F.array("a", "b")).alias("id")).distinct()
    return files.join(groups, "id").select("file", "id", "component")


def split_candidates(coupled: DataFrame, at_least: float = 0.3) -> DataFrame:
    """(node_a, groups, severity): files whose symbols fall into two or more groups that change apart.

    The severity is 1 less the modularity of the file's couplings, weak ones between the groups among them.  Symbols
    without a link count as no group; each group has two symbols or more.
    """
    groups = clusters(coupled, at_least)
    sizes = groups.groupBy("file").agg(F.countDistinct("component").alias("groups")).where("groups >= 2")
    named = coupled.join(sizes, "file")
    for end in ("a", "b"):
        named = named.join(groups.select(F.col("id").alias(end), F.col("component").alias(f"group_{end}")), end, "left").withColumn(f"group_{end}", F.coalesce(f"group_{end}", end))
    inside = F.when(F.col("group_a") == F.col("group_b"), F.col("w") / 2).otherwise(0.0)
    ends = named.select("file", "groups", F.explode(F.array(*[F.struct(F.col(f"group_{e}").alias("g"), F.col("w").alias("degree"), inside.alias("inside")) for e in ("a", "b")])).alias("e"))
    sums = ends.groupBy("file", "groups", "e.g").agg(F.sum("e.degree").alias("degree"), F.sum("e.inside").alias("inside"))
    total = sums.groupBy("file").agg((F.sum("degree") / 2).alias("m"))
    q = F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2))
    return sums.join(total, "file").groupBy("file", "groups").agg((1 - q).alias("severity")).select(F.col("file").alias("node_a"), "groups", "severity")
