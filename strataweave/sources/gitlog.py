"""Commit touches from `git -c core.quotePath=false log --first-parent --no-renames --numstat --format=%x00%H%x09%ct%x09%s`."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.defect import is_fix_message

FORMAT = ("-c", "core.quotePath=false", "log", "--first-parent", "--no-renames", "--numstat", "--format=%x00%H%x09%ct%x09%s")


def write_log(repo: str, path: str) -> None:
    with open(path, "w") as out:
        subprocess.run(["git", "-C", repo, *FORMAT], stdout=out, check=True)


def unquoted(path: Column) -> Column:
    """A path that git still quotes, for a quote, backslash or control character in it, as it is."""
    inner = F.substr(path, F.lit(2), F.length(path) - 2)
    plain = F.regexp_replace(F.replace(F.replace(inner, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1")
    return F.when(path.startswith('"') & path.endswith('"') & (F.length(path) > 1), plain).otherwise(path)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(touches, fixes) of a log: a line is a commit's or a file's; files belong to the commit above them.

    Commits are split apart by the reader at the zero byte that no message or path holds, so one commit is one record and no order over all lines is needed but the
    records' own, which numbers the commits.
    """
    records = spark.read.option("lineSep", "\0").text(path).where("value <> ''").withColumn("at", F.monotonically_increasing_id())
    head = F.split(F.substring_index("value", "\n", 1), "\t", 3)
    commits = records.select("at", head[0].alias("commit_id"), F.timestamp_seconds(F.try_to_number(head[1], F.lit("999999999999"))).cast("timestamp_ntz").alias("ts"), F.try_element_at(head, F.lit(3)).alias("message"), F.slice(F.split("value", "\n"), F.lit(2), F.size(F.split("value", "\n"))).alias("lines"))
    order = commits.select("commit_id", "at").withColumn("part", F.shiftright("at", 33))
    before = order.groupBy("part").count().withColumn("b", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "b")  # a row a file split
    numbered = order.withColumn("i", F.row_number().over(W.partitionBy("part").orderBy("at"))).join(F.broadcast(before), "part").select("commit_id", (F.col("b") + F.col("i") - 1).alias("seq"))
    line = F.split(F.col("l"), "\t", 3)
    files = commits.select("commit_id", "ts", "message", F.explode("lines").alias("l")).where(F.col("l").rlike(r"^(?:\d+|-)\t(?:\d+|-)\t"))
    # binary files have - for both numbers
    count = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    touches = files.select("commit_id", "ts", "message", unquoted(line[2]).alias("file"), (count(line[0]) + count(line[1])).alias("churn")).join(numbered, "commit_id")
    return touches.select("commit_id", "seq", "ts", "file", "churn"), touches.where(is_fix_message(F.col("message"))).select("commit_id", "file")
