"""A symbol index: documents of symbols and occurrences to a graph of calls.

documents is (relative_path, symbols array<struct<symbol,kind>>, occurrences array<struct<symbol,roles,range>>); read
it from JSON or Parquet, or with read_index from the indexers' own binary files.  An occurrence with role bit 1 defines, the others refer; a reference's caller is the innermost
definition around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import innermost, normal_range

SCHEMA = "relative_path string, symbols array<struct<symbol:string,kind:string>>, occurrences array<struct<symbol:string,roles:int,range:array<int>>>"
# Kinds that aren't modules.
KINDS = {"Function": "function", "Method": "function", "Constructor": "function", "Class": "class", "Struct": "class", "Interface": "class", "Trait": "class", "Enum": "class"}
#: A position is line * LINE + character.
LINE = 1 << 20
# Fixed values of the binary format: the numbers of those kinds.
KIND_NUMBERS = {7: "Class", 9: "Constructor", 11: "Enum", 17: "Function", 21: "Interface", 26: "Method", 49: "Struct", 53: "Trait"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers of wire type 0, bytes of type 2; those of fixed width are skipped."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield tag >> 3, value
        elif kind == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                raise ValueError("the index is cut off")
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"not an index: wire type {kind}")


def _numbers(value: int | bytes) -> list[int]:
    """One number or a packed list."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def parse_index(data: bytes) -> Iterator[tuple[str, list[dict], list[dict]]]:
    """A binary index's documents, as (relative_path, symbols, occurrences)."""
    for number, document in _fields(data):
        if number != 2:
            continue
        path, symbols, occurrences = "", [], []
        for n, part in _fields(document):
            if n == 1:
                path = part.decode()
            elif n == 2:
                seen = {"symbol": "", "roles": 0, "range": []}
                for k, v in _fields(part):
                    if k == 1:
                        seen["range"] += _numbers(v)
                    elif k == 2:
                        seen["symbol"] = v.decode()
                    elif k == 3:
                        seen["roles"] = v
                occurrences.append(seen)
            elif n == 3:
                told = dict(_fields(part))
                symbols.append({"symbol": told.get(1, b"").decode(), "kind": KIND_NUMBERS.get(told.get(5, 0))})
        yield path, symbols, occurrences


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of binary indexes below path; a file is read by one task, a document at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for row in parse_index(bytes(content)):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=["relative_path", "symbols", "occurrences"])
                        rows = []
                yield pd.DataFrame(rows, columns=["relative_path", "symbols", "occurrences"])

    from ..session import ship_package

    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def load(documents: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges).  Empty symbols, ranges of a wrong length and references outside any definition raise if strict, else are left out."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("s.kind")], F.lit("module"))
    listed = documents.select("relative_path", F.posexplode("symbols").alias("at", "s")).select(_named(F.col("s.symbol"), strict).alias("id"), kind.alias("type"), F.col("relative_path").alias("file_path"), F.lit(0).alias("prio"), "at")
    seen = documents.select("relative_path", F.posexplode("occurrences").alias("at", "o")).select("relative_path", "at", _named(F.col("o.symbol"), strict).alias("symbol"), (F.col("o.roles").bitwiseAND(1) != 0).alias("defines"), normal_range(F.col("o.range")).alias("r"))
    placed = seen.where("symbol is not null").select("relative_path", "at", "symbol", "defines", (F.col("r.line") * F.lit(LINE) + F.col("r.char")).cast("long").alias("b"), (F.col("r.end_line") * F.lit(LINE) + F.col("r.end_char")).cast("long").alias("e"))
    defined = placed.where("defines")
    bare = defined.select(F.col("symbol").alias("id"), F.lit("module").alias("type"), F.col("relative_path").alias("file_path"), F.lit(1).alias("prio"), "at")
    every = listed.where("id is not null").union(bare)
    nodes = every.groupBy("id").agg(F.min(F.struct("prio", "file_path", "at", "type")).alias("n")).select("id", "n.type", "n.file_path")
    refs = placed.where("not defines").join(nodes.select(F.col("id").alias("symbol")), "symbol", "left_semi").select("relative_path", F.col("symbol").alias("target"), F.col("at").alias("nth"), F.col("b").alias("place"), F.col("e").alias("place_end"))
    calls = innermost(defined.select("relative_path", "b", "e", F.col("symbol").alias("source")), refs, "relative_path", "b", "e", "place", "source", 64 * LINE)
    if strict:
        lost = refs.join(calls.select("relative_path", "nth"), ["relative_path", "nth"], "left_anti")
        calls = calls.unionByName(lost.withColumn("source", F.raise_error(F.concat(F.lit("no definition around the reference to "), "target")).cast("string")))
    edges = calls.select("source", "target", F.lit("structural").alias("layer"), F.lit("calls").alias("edge_type"), F.lit(1.0).alias("weight"))
    return nodes, edges


def _named(symbol, strict: bool):
    empty = F.raise_error(F.lit("an empty symbol")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.coalesce(symbol, F.lit("")) == "", empty).otherwise(symbol)
