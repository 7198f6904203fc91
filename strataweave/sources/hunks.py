"""Hunks of unified diffs: `git log -p -U0` as one row for each changed range of a file."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gitlog import unquoted

FORMAT = ("-c", "core.quotePath=false", "log", "--first-parent", "-m", "--no-renames", "--no-color", "--no-ext-diff", "-p", "-U0", "--format=%x00%H%x09%ct%x09%s")
#: A hunk's head.  Lines of content begin with a sign, so no other line begins like this.
HEAD = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def write_patches(repo: str, path: str) -> None:
    with open(path, "w") as out:
        subprocess.run(["git", "-C", repo, *FORMAT], stdout=out, check=True)


def read_hunks(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, ts, file, old_start, old_lines, new_start, new_lines) of a log with patches.

    A commit is one record, as in gitlog.  A file is named as it is after the commit, or before it where the commit
    deletes it.  Binary files and changes of mode alone have no hunks; a length that isn't said is 1.
    """
    records = spark.read.option("lineSep", "\0").text(path).where("value <> ''")
    head = F.split(F.substring_index("value", "\n", 1), "\t", 3)
    commits = records.select(head[0].alias("commit_id"), F.timestamp_seconds(F.try_to_number(head[1], F.lit("999999999999"))).cast("timestamp_ntz").alias("ts"), F.split("value", "\ndiff --git ").alias("parts"))
    files = commits.select("commit_id", "ts", F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("part"))
    names = F.array(*[unquoted(F.regexp_extract("part", rf'(?m)^{sign} ("?{side}/.*?)\t?$', 1)) for sign, side in ((r"\+\+\+", "b"), ("---", "a"))])
    named = files.withColumn("file", F.try_element_at(F.filter(names, lambda n: n != ""), F.lit(1)))
    number = lambda group: F.transform(F.regexp_extract_all("part", F.lit(HEAD), F.lit(group)), lambda x: F.when(x == "", 1).otherwise(x.cast("int")))
    zipped = F.arrays_zip(*[number(i + 1).alias(name) for i, name in enumerate(("old_start", "old_lines", "new_start", "new_lines"))])
    hunks = named.where("file is not null").select("commit_id", "ts", F.substring("file", 3, 1 << 30).alias("file"), F.explode(zipped).alias("h"))
    return hunks.select("commit_id", "ts", "file", "h.*")
