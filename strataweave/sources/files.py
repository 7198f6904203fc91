"""Source trees: listing, parsing on executors, and imports resolved by column functions."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imports as resolve
from ..functions.ignore import IgnoreRules
from ..functions.paths import language
from ..schema import FILE_ANALYSIS
from ..session import cut, ship_package
from .parsers import PARSERS, typescript

# Folders that aren't entered.
SKIPPED = ("node_modules", "__pycache__", "target", "dist", "build")
#: Folders that a task lists.
FOLDERS = 32


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root.removeprefix("file:")))


def _listed(folders: DataFrame, root: str) -> DataFrame:
    """(path, folder) of what is in each folder of (path), by tasks; links are neither entered nor read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(folder)) if x.type in (fs.FileType.Directory, fs.FileType.File) and not (local and os.path.islink(x.path))]
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in found], pa.string()), pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_())], names=["path", "folder"])

    return folders.mapInArrow(run, "path string, folder boolean")


def walk(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> DataFrame:
    """(path, language, content) of the supported files below root, paths relative to it.

    Folders are listed level by level: those of a level are dealt to tasks, and the ones found there that may be entered
    are the next level's, so hidden folders and those of SKIPPED are never looked into.  Names that begin with an
    underscore are files like others.  Contents are read in tasks, where the column is used.
    """
    rules = rules or IgnoreRules.parse("")
    system, base = _file_system(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    base = base.rstrip("/")
    name = F.substring_index("path", "/", -1)
    level, found = spark.createDataFrame([(base,)], "path string"), []
    while True:
        seen = cut(_listed(level, root))
        found.append(seen.where("not folder").select("path"))
        folders = seen.where(F.col("folder") & ~name.startswith(".") & ~name.isin(*SKIPPED)).select("path")
        n = folders.count()
        if not n:
            break
        level = folders.repartition(min(-(-n // FOLDERS), spark.sparkContext.defaultParallelism * 4))
    inside = reduce(DataFrame.union, found).withColumn("path", F.substr("path", F.lit(len(base) + 2)))
    kept = inside.where(language(F.col("path")).isNotNull() & ~rules.column(F.col("path"))).select("path", language(F.col("path")).alias("language"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(root)
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                with system.open_input_stream(f"{base}/{path}") as stream:
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([stream.read()], pa.binary())], names=["path", "language", "content"])

    return kept.mapInArrow(read, "path string, language string, content binary")


def analyze(files: DataFrame) -> DataFrame:
    """schema.FILE_ANALYSIS of (path, language, content); imports as written.  Files that can't be read have an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                functions, classes, imports, loc, error = [], [], [], None, None
                try:
                    text = bytes(content).decode()
                    loc = sum(bool(line.strip()) for line in text.split("\n"))
                    found = typescript(text, jsx=False) if kind == "typescript" and path.endswith(".ts") else PARSERS[kind](text)
                    functions, classes, imports = [m._asdict() for m in found.functions], [m._asdict() for m in found.classes], found.imports
                except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, kind, loc, functions, classes, imports, error))
            yield pd.DataFrame(rows, columns=["file_path", "language", "loc", "functions", "classes", "imports", "error"])

    ship_package(files.sparkSession)
    return files.mapInPandas(run, FILE_ANALYSIS)


# Files at the root that tell of the alias @/.
ALIAS_CONFIGS = ("vite.config.ts", "vite.config.js", "vue.config.js", "vue.config.ts")


def has_alias(spark: SparkSession, root: str) -> bool:
    """Whether a tree has the alias @/ for its src folder."""
    jvm = spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}") for name in ALIAS_CONFIGS]
    fs = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    return any(fs.exists(p) for p in paths)


def resolved(parsed: DataFrame, go_module: str | None = None, alias: bool = True) -> DataFrame:
    """parsed with its imports as paths, those that lead nowhere left out, and files with an error left out."""
    one = parsed.where("error is null").select("file_path", "language", F.posexplode("imports").alias("at", "i"))
    file, text, kind = F.col("file_path"), F.col("i"), F.col("language")
    rust = F.when(text.startswith("mod "), resolve.rust_mod(F.regexp_extract(text, r"^mod (\w+)", 1), file)).otherwise(F.array(resolve.rust_use(text)))
    places = (
        F.when(kind == "python", F.array(resolve.python_import(text, file)))
        .when(kind == "rust", rust)
        .when(kind == "go", F.array(resolve.go_import(text, go_module)))
        .when(kind == "vue", F.array(resolve.vue_import(text, alias)))
        .otherwise(F.array(resolve.ts_import(text)))
    )
    each = one.select("file_path", "at", F.posexplode(F.array_compact(places)).alias("nth", "place"))
    lists = each.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "place"))), lambda x: x["place"]).alias("places"))
    joined = parsed.where("error is null").join(lists, "file_path", "left")
    return joined.withColumn("imports", F.coalesce("places", F.array().cast("array<string>"))).drop("places", "error")


def go_module(text: str) -> str | None:
    """The module path of a go.mod."""
    return next((line.strip().removeprefix("module ").strip() for line in text.splitlines() if line.strip().startswith("module ")), None)
