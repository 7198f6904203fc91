"""A stored graph: a Parquet folder for each of six tables, replaced as a whole.

A build writes a new version beside the old one and then names it in a small file, so readers see one build or the
other.  What is appended is a version of its own, with its tables alone, and the file then names both; of rows with one
key the later version's counts.  After MAX_VERSIONS appends the tables are written together.  Edges are partitioned by layer.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.signals import ordered
from ..schema import TABLES, as_schema, empty


#: Versions that a reader puts together before an append writes them as one.
MAX_VERSIONS = 16
KEYS = {"nodes": "id", "change_metrics": "node_id", "defect_metrics": "node_id", "build_info": "key"}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def versions(self) -> list[str]:
        """The versions that make up the current build, oldest first."""
        if not self._exists(f"{self.path}/CURRENT"):
            return []
        return [v for (line,) in self.spark.read.text(f"{self.path}/CURRENT").collect() for v in line.split()]  # one short line

    def table(self, name: str) -> DataFrame:
        """A table of the current build; without one, an empty table."""
        schema = TABLES[name]
        paths = [p for v in self.versions() if self._exists(p := f"{self.path}/{v}/{name}")]
        if not paths:
            return empty(self.spark, schema)
        return self._latest(name, [as_schema(self.spark.read.schema(schema).parquet(p), schema) for p in paths])

    def _latest(self, name: str, frames: list[DataFrame]) -> DataFrame:
        """Frames put together; of rows with one key those of the last frame, and there the last row."""
        key = KEYS.get(name)
        if not key or len(frames) == 1:
            return reduce(DataFrame.unionByName, frames)
        placed = reduce(DataFrame.unionByName, [f.withColumn("_at", F.lit(i)) for i, f in enumerate(frames)])
        return self._last(placed, key)

    def _last(self, placed: DataFrame, key: str) -> DataFrame:
        others = [c for c in placed.columns if c not in (key, "_at")]
        return placed.groupBy(key).agg(F.max_by(F.struct(*others), "_at").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])

    def write(self, **tables: DataFrame) -> None:
        """A new build; tables not given are empty.  Of rows with one key the last one written stays."""
        self._name([self._version({name: tables.get(name, empty(self.spark, TABLES[name])) for name in TABLES})])

    def append(self, **tables: DataFrame) -> None:
        """Add to the current build: rows with a key replace those that have it, edges and signals come beside those there.

        Only the tables given are written, and only their rows.
        """
        versions = [*self.versions(), self._version(tables)]
        self._name(versions)
        if len(versions) > MAX_VERSIONS:
            self.compact()

    def compact(self) -> None:
        """The current build as one version."""
        self._name([self._version({name: self.table(name) for name in TABLES})])

    def _version(self, tables: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df = as_schema(df, TABLES[name])
            if name in KEYS:
                df = self._last(df.withColumn("_at", F.monotonically_increasing_id()), KEYS[name])
            writer = df.write.partitionBy("layer") if name == "edges" else df.write
            writer.parquet(f"{self.path}/{version}/{name}")
        return version

    def _name(self, versions: list[str]) -> None:
        self.spark.createDataFrame([(" ".join(versions),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/CURRENT")

    def clear(self) -> None:
        self.write()


def stored_signals(signals: DataFrame, when=None) -> DataFrame:
    """schema.STORED_SIGNALS: numbered by severity, the whole signal as JSON in details."""
    found = ordered(signals)
    place = F.row_number().over(W.orderBy(F.desc("severity"), "signal_type", "node_a", F.asc_nulls_first("node_b")))  # signals are few beside what they are found in
    return found.select(place.cast("long").alias("id"), "signal_type", "node_a", "node_b", "severity", F.to_json(F.struct(*signals.columns)).alias("details"), (F.current_timestamp() if when is None else F.lit(when).cast("timestamp")).alias("detected_at"))


def described(stored: DataFrame) -> DataFrame:
    """Stored signals with their description; null where details aren't JSON."""
    return stored.withColumn("description", F.get_json_object("details", "$.description"))
