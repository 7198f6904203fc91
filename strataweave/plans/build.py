"""A build: source tree and git history to the stored graph and its signals."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.ignore import IgnoreRules
from ..operators import change, defect, graphops, signals, structural
from ..schema import EDGES, NODES, as_schema
from ..session import cut, scratch
from ..sources import files, gitlog
from .store import Store, stored_signals


def change_graph(touches: DataFrame, now, config: Config, rules: IgnoreRules) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, change metrics, the touches looked at)."""
    seen = cut(change.windowed(touches, now, config.build, rules))
    freq = change.frequencies(seen)
    coupled = cut(change.couplings(change.co_change_pairs(seen, config.build.max_files_per_commit), freq, config.build.min_co_changes, config.build.min_coupling))
    nodes = as_schema(freq.select(F.col("file").alias("id"), F.lit("module").alias("type"), F.col("file").alias("file_path")), NODES)
    return nodes, change.co_change_edges(coupled), change.change_metrics(freq, coupled), seen


def build_all(spark: SparkSession, parsed: DataFrame, touches: DataFrame, fixes: DataFrame | None, config: Config, rules: IgnoreRules, now=None) -> signals.Graph:
    """All layers as one graph: structural nodes win over those of the history alone."""
    now = F.lit(now) if now is not None else F.current_timestamp().cast("timestamp_ntz")
    s_nodes, s_edges = structural.build_structural(parsed)
    c_nodes, c_edges, metrics, seen = change_graph(touches, now, config, rules)
    nodes, edges = graphops.merge_graphs((s_nodes, s_edges), (c_nodes, c_edges))
    nodes = cut(as_schema(nodes, NODES))
    fixes = fixes.join(seen.select("commit_id", "file"), ["commit_id", "file"], "left_semi") if fixes is not None else seen.select("commit_id", "file").limit(0)
    fixes = cut(fixes)
    edges = edges.unionByName(defect.defect_edges(defect.fault_propagates(seen, fixes, config.build.max_files_per_commit), defect.co_fix(fixes, config.build.max_files_per_commit)), allowMissingColumns=True)
    found = nodes.select(F.col("id").alias("file"), "loc")
    return signals.Graph(nodes, cut(as_schema(edges, EDGES)), cut(metrics), cut(defect.defect_metrics(seen, fixes, found)), signals.limits_of(nodes, config.thresholds))


def build(spark: SparkSession, repo: str, store: str, config: Config, now=None) -> signals.Graph:
    """Read a repository, find its signals and store all tables."""
    root = Path(repo).resolve()
    rules = IgnoreRules.load(root)
    module = files.go_module((root / "go.mod").read_text()) if (root / "go.mod").exists() else None
    parsed = cut(files.resolved(files.analyze(files.walk(spark, str(root), rules)), module, files.has_alias(spark, str(root))))
    with tempfile.TemporaryDirectory() as folder:  # git writes on the driver; executors read the shared folder
        log, shared = f"{folder}/log.txt", scratch(spark, "log")
        gitlog.write_log(str(root), log)
        where = spark._jvm.org.apache.hadoop.fs.Path(shared)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{log}"), where)
        touches, fixes = gitlog.read_log(spark, shared)
        touches, fixes = cut(touches), cut(fixes)
    g = build_all(spark, parsed, touches, fixes, config, rules, now)
    found = cut(signals.detect_signals(g))
    info = spark.createDataFrame([("repo_path", str(root)), ("time_window", config.build.time_window)], "key string, value string").union(spark.range(1).select(F.lit("last_build"), F.current_timestamp().cast("string")))
    Store(spark, store).write(nodes=g.nodes, edges=g.edges, change_metrics=g.change, defect_metrics=g.defect, signals=stored_signals(found), build_info=info)
    return g
