"""Headline queries once over $BENCH_SF_DIR on local[$BENCH_CPUS], and a build of a repository; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from strataweave import catalog
from strataweave.cli import Reader
from strataweave.config import Config
from strataweave.plans.build import build
from strataweave.session import ship_package

HEADLINES = ("hotspots_topk", "co_change_pairs", "coupling_edges", "hotspots_stored", "change_propagates", "import_edges", "instability", "fault_propagation", "signal_ghost_coupling", "signal_god_module", "signals_all", "scc_members", "neighborhood_d2", "viz_nodes", "percent_ranks", "range_innermost", "path_predicates", "doc_loc", "json_details")


def timed(work: Callable[[], object]) -> float:
    began = time.perf_counter()
    work()
    return round(time.perf_counter() - began, 3)


def with_history(folder: str) -> str:
    """A repository of this package's own files in folder, changed in forty commits."""
    root = Path(folder) / "repo"
    shutil.copytree(Path(__file__).resolve().parent / "strataweave", root / "strataweave", ignore=shutil.ignore_patterns("__pycache__"))
    git = lambda *args: subprocess.run(["git", "-C", str(root), "-c", "user.name=bench", "-c", "user.email=bench@localhost", *args], check=True, capture_output=True)
    git("init", "-q")
    paths = sorted(root.rglob("*.py"))
    for i in range(40):
        for path in paths[i % 5 :: 5][:12] if i else []:
            path.write_text(path.read_text() + f"# {i}\n")
        git("add", "-A")
        git("commit", "-qm", f"{'fix' if i % 7 == 3 else 'step'} {i}")
    return str(root)


def repository(spark: SparkSession) -> dict[str, float]:
    """What the baseline has figures for: a full build (of this package), an impact query and an export of the stored graph."""
    with tempfile.TemporaryDirectory() as folder:
        root = with_history(folder)
        took = {"repo_build": timed(lambda: build(spark, root, f"{folder}/store", Config()))}
        reader = Reader(spark, f"{folder}/store")
        took["repo_impact"] = timed(lambda: reader.impact("strataweave/session.py").collect())
        took["repo_viz_export"] = timed(lambda: reader.export("viz-json"))
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    catalog.QUERIES["hotspots_topk"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts what later queries find running
    took = {name: timed(lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINES}
    total = round(sum(took.values()), 3)
    try:
        took |= repository(spark)
    except Exception as e:  # without git the headline queries count all the same
        took["repo_error"] = str(e)[:200]
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
