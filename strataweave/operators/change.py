"""The change layer: commit touches to change metrics and co-change edges.

touches is (commit_id, seq, ts, file, churn): one row for each file of a commit, seq 0 for the newest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Build
from ..functions.ignore import IgnoreRules
from ..functions.paths import language

# Days of a unit.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
#: Old commits in a row after which the history isn't read further.
MAX_OLD_RUN = 100


def window_days(text: str) -> int | None:
    """Days of a text like '6 months ago'; None if it says nothing, which means no cutoff."""
    match = re.match(r"\s*(\d+)\s+([a-zA-Z]+)", text)
    return int(match[1]) * UNIT_DAYS[unit] if match and (unit := match[2].lower().removesuffix("s")) in UNIT_DAYS else None


def in_window(ts: Column, now: Column, window: str) -> Column:
    """Commits without a time are inside."""
    days = window_days(window)
    return F.lit(True) if days is None else ts.isNull() | (ts >= now - F.expr(f"INTERVAL '{days}' DAY"))


def kept_files(touches: DataFrame, rules: IgnoreRules | None = None) -> DataFrame:
    """Touches of supported files that aren't ignored."""
    rules = rules or IgnoreRules.parse("")
    return touches.where(language(F.col("file")).isNotNull() & ~rules.column(F.col("file")))


def running_total(df: DataFrame, order: str, value: Column, name: str, blocks: int = 256) -> DataFrame:
    """df with the sum of value over rows up to each row's place by order (a long column, without repeats).

    Rows are summed in blocks of neighbouring places, whose own sums then shift them, so no task holds all rows.
    """
    span = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    low, width = (span["a"] or 0), max(1, ((span["b"] or 0) - (span["a"] or 0)) // blocks + 1)
    block = F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("long")
    rows = df.withColumn("_b", block).withColumn("_v", value)
    before = rows.groupBy("_b").agg(F.sum("_v").alias("_t")).withColumn("_t", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most `blocks` rows
    own = rows.withColumn("_r", F.sum("_v").over(W.partitionBy("_b").orderBy(order)))
    return own.join(F.broadcast(before), "_b").withColumn(name, F.col("_r") + F.col("_t")).drop("_b", "_v", "_r", "_t")


def early_stop(commits: DataFrame, inside: Column, limit: int = MAX_OLD_RUN) -> DataFrame:
    """commits (with seq) up to where more than limit in a row, newest first, are outside the window."""
    marked = running_total(commits.withColumn("_in", inside.cast("int")), "seq", F.col("_in"), "_run")
    # a commit inside begins a run of its number; the old ones after it share it
    old = marked.where("_in = 0").withColumn("_nth", F.row_number().over(W.partitionBy("_run").orderBy("seq")))
    stop = old.where(F.col("_nth") == limit + 1).agg(F.min("seq").alias("_stop"))
    return marked.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_in", "_run", "_stop")


def commit_cap(touches: DataFrame, most: int) -> DataFrame:
    """Touches of the newest `most` commits that have any; 0 means all."""
    if most == 0:
        return touches
    commits = touches.select("commit_id", "seq").distinct()
    counted = running_total(commits, "seq", F.lit(1), "_n").where(F.col("_n") <= most).select("commit_id")
    return touches.join(counted, "commit_id", "left_semi")


def windowed(touches: DataFrame, now: Column, build: Build, rules: IgnoreRules | None = None) -> DataFrame:
    """The touches that a build looks at: in the window, before the early stop, of kept files, under the cap."""
    commits = early_stop(touches.select("commit_id", "seq", "ts").distinct(), in_window(F.col("ts"), now, build.time_window))
    kept = commits.where(in_window(F.col("ts"), now, build.time_window)).select("commit_id")
    return commit_cap(kept_files(touches.join(kept, "commit_id", "left_semi"), rules), build.max_commits)


def frequencies(touches: DataFrame) -> DataFrame:
    """(file, change_freq, churn_lines, churn_rate, last_changed)."""
    return touches.groupBy("file").agg(F.count("*").alias("change_freq"), F.sum("churn").cast("long").alias("churn_lines"), F.max("ts").cast("string").alias("last_changed")).withColumn("churn_rate", F.when(F.col("change_freq") > 0, F.col("churn_lines") / F.col("change_freq")).otherwise(0.0))


def bulk_commits(touches: DataFrame, most: int) -> DataFrame:
    """(commit_id, n_files) of commits with more files than take part in pairs."""
    return touches.groupBy("commit_id").agg(F.count("*").alias("n_files")).where(F.col("n_files") > most)


def co_change_pairs(touches: DataFrame, max_files: int) -> DataFrame:
    """(a, b, cnt), a < b: in how many commits of at most max_files files both are.

    A commit's files are gathered first, so the shuffle moves each touch once, and a pair is made where its commit is;
    the cut bounds both the array and its pairs.  Pairs are counted before they are shuffled.
    """
    files = touches.groupBy("commit_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("file")).alias("files")).where((F.col("n") <= max_files) & (F.col("n") > 1))
    first = files.select("files", F.posexplode("files").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("cnt"))


def couplings(pairs: DataFrame, freq: DataFrame, min_co_changes: int, min_coupling: float = 0.0) -> DataFrame:
    """(a, b, cnt, w): pairs often enough together, by the share of the rarer one's commits."""
    f = freq.select("file", "change_freq")
    often = pairs.where(F.col("cnt") >= min_co_changes)
    both = often.join(f.toDF("a", "fa"), "a").join(f.toDF("b", "fb"), "b")
    return both.select("a", "b", "cnt", (F.col("cnt") / F.least("fa", "fb")).alias("w")).where(F.col("w") >= min_coupling)


def sum_couplings(coupled: DataFrame) -> DataFrame:
    """(file, sum_coupling) over the pairs at either end."""
    ends = coupled.select(F.explode(F.array("a", "b")).alias("file"), "w")
    return ends.groupBy("file").agg(F.sum("w").alias("sum_coupling"))


def change_metrics(freq: DataFrame, coupled: DataFrame) -> DataFrame:
    """(node_id, change_freq, churn_lines, churn_rate, hotspot_score, sum_coupling, last_changed): the score is by frequency alone."""
    top = freq.agg(F.max("change_freq").alias("_top"))
    joined = freq.join(F.broadcast(top)).join(sum_couplings(coupled), "file", "left")
    return joined.select(F.col("file").alias("node_id"), "change_freq", "churn_lines", "churn_rate", (F.col("change_freq") / F.col("_top")).alias("hotspot_score"), F.coalesce("sum_coupling", F.lit(0.0)).alias("sum_coupling"), "last_changed")


def co_change_edges(coupled: DataFrame) -> DataFrame:
    return coupled.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("change").alias("layer"), F.lit("co_changes").alias("edge_type"), F.col("w").alias("weight"))


#: Neighbouring commits that are looked at together.
BLOCK = 4096


def change_propagates(touches: DataFrame, within: int, max_files: int) -> DataFrame:
    """Extension: (source, target, cnt, weight): target changed in one of the next `within` commits after source did.

    Commits go by blocks of neighbouring places, the last places of a block also to the next one, whose commits are older, so a touch is
    shuffled about once.  There a commit meets those after it, targets of several of them count once, and pairs are counted
    before they are shuffled.
    """
    block = lambda place: F.floor(place / F.lit(BLOCK)).cast("long")
    here = block(F.col("seq"))
    ahead = F.sequence(here, block(F.col("seq") + within))
    rows = touches.where("seq is not null").select(F.explode(ahead).alias("block"), "seq", "file").repartition("block")
    files = rows.groupBy("block", "seq").agg(F.count("*").alias("n"), F.collect_set("file").alias("own")).where(F.col("n") <= max_files)
    after = F.array_distinct(F.flatten(F.collect_list("own").over(W.partitionBy("block").orderBy("seq").rangeBetween(-within, -1))))
    placed = files.withColumn("next", after).where(here == F.col("block")).where("size(own) > 0 and size(next) > 0")
    pairs = placed.select(F.explode("own").alias("source"), "next").select("source", F.explode("next").alias("target")).where("source <> target")
    times = pairs.groupBy("source", "target").agg(F.count("*").alias("cnt"))
    return times.join(frequencies(touches).select(F.col("file").alias("source"), "change_freq"), "source").select("source", "target", "cnt", (F.col("cnt") / F.col("change_freq")).alias("weight"))
