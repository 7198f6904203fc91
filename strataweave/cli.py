"""python -m strataweave.cli build|impact|hotspots|signals|stats|export|serve"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load_config
from .operators import locate
from .operators.components import strong_components
from .plans import export, queries
from .plans.build import build
from .plans.store import Store, described
from .schema import PRIORITY
from .session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataweave")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, shown: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("--db", default="graph-store", help="folder of the stored graph")
        if shown:
            p.add_argument("--format", choices=("text", "json"), default="text")
        return p

    p = command("build", "read a repository and store its graph", False)
    p.add_argument("--repo-path", default=".")
    p.add_argument("--since")
    p.add_argument("--config", default="strataweave.toml")
    command("impact", "what a node is tied to", False).add_argument("target")
    command("hotspots", "files that change much and are complex").add_argument("--top", type=int, default=20)
    p = command("signals", "what the layers say together")
    p.add_argument("--type")
    p.add_argument("--min-severity", type=float)
    command("stats", "counts of the graph")
    p = command("export", "the graph as a text", False)
    p.add_argument("--format", choices=("json", "dot", "mermaid", "viz-json"), required=True)
    p.add_argument("--output", help="a file, or with --parts a folder")
    p.add_argument("--parts", type=int, help="write the text as so many files, in order")
    p = command("locate", "the nodes that words lead to")
    p.add_argument("intent")
    p.add_argument("--top", type=int, default=10)
    command("serve", "answer over HTTP", False).add_argument("--port", type=int, default=3000)
    return top


class Reader:
    """The stored graph's tables, and the answers that CLI and server share."""

    def __init__(self, spark: SparkSession, path: str):
        store = Store(spark, path)
        self.nodes, self.edges, self.change, self.defect, self.info = (store.table(t) for t in ("nodes", "edges", "change_metrics", "defect_metrics", "build_info"))
        self.detailed = described(store.table("signals")).select("signal_type", "node_a", "node_b", "severity", "description", "details")
        self.signals = self.detailed.drop("details")

    def hotspots(self, top: int) -> DataFrame:
        return queries.rank_hotspots(self.nodes, self.change, top)

    def stats(self) -> DataFrame:
        return queries.stats(self.nodes, self.edges, self.signals)

    def impact(self, target: str) -> DataFrame:
        return queries.impact(self.nodes, self.edges, self.signals, self.change, target)

    def locate(self, intent: str, top: int) -> DataFrame:
        return locate.ranked(locate.index(self.nodes), self.edges, self.change, intent, top)

    def lines(self, kind: str) -> DataFrame:
        """The ordered lines of an export."""
        if kind == "viz-json":
            return export.viz_json_lines(queries.viz_nodes(self.nodes, self.edges, self.change, self.defect, document=True), self.edges, self.detailed, self.info)
        if kind == "json":
            raise ValueError("the summary is one text, without parts")
        return {"dot": export.dot_lines, "mermaid": export.mermaid_lines}[kind](queries.hotspots(self.nodes, self.change, 50), self.signals)

    def export(self, kind: str) -> str:
        if kind == "json":
            return export.summary_json(self.stats(), self.signals, queries.hotspots(self.nodes, self.change, 100)).first()["text"]
        return export.as_text(self.lines(kind)).first()["text"]


def show(frame: DataFrame, kind: str) -> None:
    for line in frame.toJSON().collect():  # reports of a few rows
        print(line if kind == "json" else "  ".join(f"{k}={v}" for k, v in json.loads(line).items()))


def summary(reader: Reader) -> None:
    """What a build has found: counts, cycles, and the five most severe signals."""
    counts = reader.stats().first().asDict()
    counts["cycles"] = strong_components(reader.edges).agg(F.countDistinct("component")).first()[0]
    print("Build complete:")
    for name in ("total_nodes", "structural_edges", "change_edges", "defect_edges", "cycles", "total_signals"):
        print(f"  {name.replace('_', ' ')}: {counts[name]}")
    for s in queries.signals_where(reader.signals).limit(5).collect():
        target = s["node_a"] if s["node_b"] is None else f"{s['node_a']} <-> {s['node_b']}"
        print(f"  [{PRIORITY[s['signal_type']].upper()}] {s['signal_type']}: {target}")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0; 1 for the impact of an unknown node; 2 for errors."""
    a = parser().parse_args(args)
    try:
        spark = spark or local_session()
        if a.command == "build":
            config = load_config(a.config)
            if a.since:
                config = dataclasses.replace(config, build=dataclasses.replace(config.build, time_window=a.since))
            build(spark, a.repo_path, a.db, config)
            reader = Reader(spark, a.db)
            summary(reader)
            return 0
        reader = Reader(spark, a.db)
        if a.command == "impact":
            answer = reader.impact(a.target)
            show(answer, "json")
            return 0 if answer.first()["exists"] else 1
        if a.command == "hotspots":
            show(reader.hotspots(a.top), a.format)
        elif a.command == "signals":
            show(queries.signals_where(reader.signals, a.type, a.min_severity), a.format)
        elif a.command == "locate":
            show(reader.locate(a.intent, a.top), a.format)
        elif a.command == "stats":
            show(reader.stats(), a.format)
        elif a.command == "export":
            if a.parts:
                if not a.output:
                    raise ValueError("--parts needs --output")
                export.write_parts(reader.lines(a.format), a.output, a.parts)
                return 0
            text = reader.export(a.format)
            Path(a.output).write_text(text) if a.output else print(text)
        else:
            from .server import serve

            serve(reader, a.port)
        return 0
    except Exception as e:  # what fails is told, not traced
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
