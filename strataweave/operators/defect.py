"""The defect layer, from fixes: an extension, as no builder of the model's origin makes this layer.

fixes is (commit_id, file): the files that a fixing commit changes.  A change is taken to induce a fix of a file if
both are in one commit window, here the commit itself: fault_propagates(a, b) is the share of a's commits in which b
was fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a message that tell a fix.
FIX_WORDS = ("fix", "bug", "hotfix", "patch", "revert")


def is_fix_message(message: Column) -> Column:
    """One of the words, by itself or with a common ending, not inside another word such as prefix, debug or dispatch."""
    return F.lower(message).rlike(r"\b(?:" + "|".join(FIX_WORDS) + r")(?:es|ed|s|ing)?\b")


def defect_metrics(touches: DataFrame, fixes: DataFrame, loc: DataFrame) -> DataFrame:
    """(node_id, bug_count, defect_density, fix_inducing_rate) of every file with a fix; loc is (file, loc)."""
    bugs = fixes.select("commit_id", "file").distinct().groupBy("file").agg(F.count("*").alias("bug_count"))
    return bug_rates(bugs, touches.groupBy("file").agg(F.count("*").alias("n")), loc)


def bug_rates(bugs: DataFrame, freq: DataFrame, loc: DataFrame) -> DataFrame:
    """As defect_metrics, from (file, bug_count) and (file, n)."""
    joined = bugs.join(loc, "file", "left").join(freq, "file", "left")
    return joined.select(F.col("file").alias("node_id"), "bug_count", F.coalesce(F.try_divide(F.col("bug_count"), F.col("loc")), F.lit(0.0)).alias("defect_density"), F.coalesce(F.try_divide(F.col("bug_count"), F.col("n")), F.lit(0.0)).alias("fix_inducing_rate"))


def _fix_pairs(touches: DataFrame, fixes: DataFrame, max_files: int) -> DataFrame:
    small = touches.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_files).select("commit_id")
    fixed = fixes.select("commit_id", F.col("file").alias("target")).distinct().join(small, "commit_id", "left_semi")
    return touches.select("commit_id", F.col("file").alias("source")).join(fixed, "commit_id").where("source <> target")


def fault_propagates(touches: DataFrame, fixes: DataFrame, max_files: int) -> DataFrame:
    """(source, target, cnt, weight)."""
    times = _fix_pairs(touches, fixes, max_files).groupBy("source", "target").agg(F.count("*").alias("cnt"))
    return fault_shares(times, touches.groupBy("file").agg(F.count("*").alias("n")))


def fault_shares(times: DataFrame, freq: DataFrame) -> DataFrame:
    """As fault_propagates, from (source, target, cnt) and (file, n)."""
    return times.join(freq.withColumnRenamed("file", "source"), "source").select("source", "target", "cnt", (F.col("cnt") / F.col("n")).alias("weight"))


def co_fix(fixes: DataFrame, max_files: int) -> DataFrame:
    """(source, target, weight), source < target: in how many fixing commits both are fixed."""
    from .change import co_change_pairs

    return co_change_pairs(fixes.select("commit_id", "file").distinct(), max_files).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("cnt").cast("double").alias("weight"))


def defect_edges(faults: DataFrame, together: DataFrame | None = None) -> DataFrame:
    def of(df: DataFrame, kind: str) -> DataFrame:
        return df.select("source", "target", F.lit("defect").alias("layer"), F.lit(kind).alias("edge_type"), F.col("weight").cast("double").alias("weight"))

    out = of(faults, "fault_propagates")
    return out if together is None else out.unionByName(of(together, "co_fix"))
