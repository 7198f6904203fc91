"""Schemas of the graph's tables and of what parsers give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, type string, file_path string, line_start int, line_end int, language string, loc int, complexity int, nesting_depth int"
#: edge_seq is an import's place among its file's, and null for edges that aren't in a file.
EDGES = "source string, target string, layer string, edge_type string, weight double, metadata string, edge_seq long"
CHANGE_METRICS = "node_id string, change_freq long, churn_lines long, churn_rate double, hotspot_score double, sum_coupling double, last_changed string"
DEFECT_METRICS = "node_id string, bug_count long, defect_density double, fix_inducing_rate double"
SIGNALS = "signal_type string, node_a string, node_b string, severity double, description string"
STORED_SIGNALS = "id long, signal_type string, node_a string, node_b string, severity double, details string, detected_at timestamp"
BUILD_INFO = "key string, value string"
TOUCHES = "commit_id string, seq long, ts timestamp_ntz, file string, churn long"
MEMBER = "struct<name:string,line_start:int,line_end:int,complexity:int>"
FILE_ANALYSIS = f"file_path string, language string, loc int, functions array<{MEMBER}>, classes array<{MEMBER}>, imports array<string>, error string"

TABLES = {"nodes": NODES, "edges": EDGES, "change_metrics": CHANGE_METRICS, "defect_metrics": DEFECT_METRICS, "signals": STORED_SIGNALS, "build_info": BUILD_INFO}

#: Each edge type's layer.
LAYER_OF = {"calls": "structural", "imports": "structural", "inherits": "structural", "contains": "structural", "co_changes": "change", "change_propagates": "change", "fault_propagates": "defect", "co_fix": "defect"}
#: Each signal type's priority.
PRIORITY = {"ghost_coupling": "high", "fragile_boundary": "critical", "over_engineering": "info", "stable_core": "guard", "ticking_bomb": "critical", "dependency_cycle": "critical", "god_module": "high", "shotgun_surgery": "high", "unstable_dependency": "high"}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def as_schema(df: DataFrame, schema: str) -> DataFrame:
    """df's columns in a schema's order and types; those that it lacks are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
